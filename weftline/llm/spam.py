"""Keyword runs, link lists and product tags in place of sentences.

Each text line is described by how dense in signs, how repetitive, how even in its words and how poor in function
words it is. Per language, location and scatter of these features are estimated robustly (concentration steps: the
moments of the closer half of the lines, again and again) over distinct pages, so that copies of one page are no norm
of their own, and a line far from them by Mahalanobis distance, in a direction that points to spam, is flagged. A document in which more than half of the text lines are flagged is found.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

#: The most frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and or but if of to in on at for from with by is are was were be been am do does did have has had not no so as it its this that these those he she they we you i me my your his her our their them him us who what why where when how can could would should will never there here than then just only over under up down out about before after back into all some any more".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder aber wenn von zu zum zur in im an am auf für aus mit bei ist sind war waren sein bin hast habe hat haben hatte nicht kein keine nie so als wie es dies dieser er sie wir ihr du ich mich mir mein meine dein uns euch ihn ihm wer was warum wo wann kann konnte hätte hätten würde soll sollen will da hier nur noch schon doch mal über unter vor nach mehr niemand nichts dass um".split(),
    "fr": "le la les un une des du de d l et ou mais si à au aux en dans sur pour par avec est sont était être suis es ai as a avons avez ont ne n pas plus jamais ce c cette ces qui que qu quoi pourquoi où quand comment il elle ils elles nous vous tu je j me m te t se s mon ma ton ta son sa leur on y ici là rien personne tout très avant après chez sous".split(),
    "es": "el la los las un una unos unas y o pero si de del a al en con por para sin sobre es son era fue ser estar está están he has ha hemos han no ni nunca nada nadie lo le les me te se nos mi tu su que qué quién por qué dónde cuándo cómo ya más muy aquí ahí allí este esta eso esa yo él ella ellos hay bajo antes después todo".split(),
}
#: Each function word with the places of its languages.
LANGUAGES_OF = {w: tuple(i for i, own in enumerate(FUNCTION_WORDS.values()) if w in own) for words in FUNCTION_WORDS.values() for w in words}
LINE = re.compile(r"\r\n|\r|\n")
MARKUP = re.compile(r"<[^<>]+>|\{\\[^{}]*\}")
TIME = re.compile(r"\d+:\d+.*-->|-->\s*\d+:\d+")
HEADER = re.compile(r"^(?:WEBVTT|NOTE|STYLE|REGION|Kind:|Language:|X-TIMESTAMP)\b")
# an address with its scheme, a spaced-out one, or a host: names in lower case joined by points, the last of letters only
LINK = re.compile(
    r"(?:[Hh][TtXx]{2}[Pp][Ss]?://|[Ww]{3}\.)\S+|\b[Ww]{3}\s+\.\s+[\w-]+(?:\s+\.\s+[\w-]+)*(?:/\S*)?"
    r"|(?<![\w.-])(?!\d+\.)[a-z0-9-]{2,}+(?:\.[a-z0-9-]{2,}+)++(?<=[a-z][a-z])(?![\w-])(?:[/?]\S*)?")
ENCLOSED = re.compile(r"[\[(*]([^\[\]()*]*)[\])*]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
SIGN = re.compile(r"[#$%&+/;<=>@\\^`|~\[\]{}]|\d|_")
FEATURES = ("density", "links", "joints", "repetition", "evenness", "function_words")
JOINT = re.compile(r"[,|;/•]|\s[-–]\s|[\[\]#_]")
#: Least spread of each feature: what a sentence may vary by without being odd.
FLOOR = (0.35, 0.25, 0.35, 0.35, 0.35, 0.55)


MISREAD = re.compile("[\xc2-\xf4\u0192\u201a-\u201e]")
_BYTES = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _repaired(line: str) -> str:
    """UTF-8 that was read as a Western single-byte encoding, once or twice, read rightly."""
    for _ in range(2):
        if not MISREAD.search(line):
            break
        try:
            line = line.translate(_BYTES).encode("latin-1").decode("utf-8")
        except UnicodeError:
            break
    return line


def text_lines(text: str) -> list[str]:
    """The text lines of a subtitle file: without cue numbers, time lines, headers and blank lines."""
    out = []
    for raw in LINE.split(text.replace("\u00ef\u00bb\u00bf", "")):
        line = raw.strip("\ufeff\u200b \t").strip()
        if not line or line.isdigit() or ("-->" in line and TIME.search(line)) or (line[0] in "WNSRKLX" and HEADER.match(line)):
            continue
        out.append(_repaired(line) if not line.isascii() else line)
    return out


def described(line: str) -> tuple[tuple[float, ...], tuple[int, ...]]:
    """Six numbers that grow the less a line is like a sentence, near 0 for short or ordinary lines; and its function words per language."""
    plain = (MARKUP.sub(" ", line) if "<" in line or "{" in line else line).strip()
    if plain[:1] in "[(*" and (m := ENCLOSED.fullmatch(plain)):
        plain = m[1]  # a sound description
    links, rest = 0, plain
    if "." in plain or "://" in plain:
        rest, links = LINK.subn(" ", plain)
    words = WORD.findall(rest.lower())
    n = len(words)
    density = len(SIGN.findall(rest)) / math.sqrt(max(len(rest) - rest.count(" "), 1))
    joints = len(JOINT.findall(rest)) / math.sqrt(n + 1)
    content, hits = [], [0] * len(FUNCTION_WORDS)
    for w in words:
        langs = LANGUAGES_OF.get(w)
        if langs is None and ("'" in w or "’" in w):
            langs = LANGUAGES_OF.get(w.split("'")[0].split("’")[0])
        if langs is None:
            content.append(w)
        else:
            for i in langs:
                hits[i] += 1
    k = len(content)
    distinct = len(set(content))
    repetition = (k - distinct) / math.sqrt(n) if n > 2 else 0.0
    evenness = 0.0  # as long as no word is repeated
    if k > 2 and distinct < k:
        evenness = (math.log2(k) + sum(c / k * math.log2(c / k) for c in Counter(content).values())) * math.sqrt(n) / 2
    lacking = (0.35 * n - (n - k)) / math.sqrt(n * 0.35 * 0.65) if n > 1 else 0.0
    return (density, math.log1p(3.0 * links), joints, repetition, evenness, max(-1.5, lacking)), tuple(hits)


def features(line: str) -> tuple[float, ...]:
    return described(line)[0]


def language_of(hits: list[int]) -> str:
    """The language with the most function words; ``und`` where there are none."""
    most = max(hits, default=0)
    return list(FUNCTION_WORDS)[hits.index(most)] if most else "und"


GRID = np.linspace(-2.0, 14.0, 321)
BINS = np.concatenate([[0.0], np.geomspace(0.05, 5000.0, 90), [np.inf]])
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
WIDTH = 1 + len(FEATURES) + len(PAIRS)
Model = tuple[np.ndarray, np.ndarray]  # location, inverse scatter
CACHE = 200_000


def describe(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang, lines, page): per document the features of its text lines, one row each, and a hash of these lines.

    Null texts are left out. Cue numbers, times and line ends do not count for the hash.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                langs, rows, pages = [], [], []
                for value in part["t"]:
                    lines = text_lines(value)
                    if len(known) > CACHE:
                        known.clear()
                    own: list[float] = []
                    hits: list[tuple[int, ...]] = []
                    for line in lines:
                        if (f := known.get(line)) is None:
                            f = known[line] = described(line)
                        own.extend(f[0])
                        hits.append(f[1])
                    langs.append(language_of([sum(x) for x in zip(*hits)]))
                    rows.append(own)
                    pages.append(xxhash.xxh64_intdigest("\n".join(lines).encode("utf-8", "surrogatepass")) - 2**63)
                yield pd.DataFrame({"k": part["k"].to_numpy(), "lang": langs, "lines": rows, "page": pages})

    # keys travel as text, so that nulls among them do not turn whole numbers into floats
    source = documents.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return source.mapInPandas(run, "k string, lang string, lines array<float>, page bigint")


def _matrices(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    for lang, part in pdf.groupby("lang"):
        rows = [np.asarray(x, dtype=np.float64) for x in part["lines"] if len(x)]
        if rows:
            yield str(lang), np.concatenate(rows).reshape(-1, len(FEATURES))


def _groups(lang: str) -> tuple[str, ...]:
    # documents in no language are measured against the lines of all languages, and add nothing to them
    return () if lang == "und" else (lang, "und")


def _distance(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared Mahalanobis distances, and what deviations towards spam contribute to them."""
    y = x - model[0]
    parts = y * (y @ model[1])
    return parts.sum(1), np.where(y > 0, parts, 0).sum(1)


def _start(described: DataFrame) -> dict[str, Model]:
    """Medians and quartile ranges, from histograms on a fixed grid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, x in _matrices(pdf):
                place = np.clip(np.searchsorted(GRID, x), 0, len(GRID) - 1)
                for g in _groups(lang):
                    own = acc.setdefault(g, np.zeros((len(FEATURES), len(GRID)), dtype=np.int64))
                    for f in range(len(FEATURES)):
                        own[f] += np.bincount(place[:, f], minlength=len(GRID))
        rows = [(g, f, int(b), int(own[f, b])) for g, own in acc.items() for f in range(len(FEATURES)) for b in np.flatnonzero(own[f])]
        yield pd.DataFrame(rows, columns=["g", "f", "b", "n"])

    counted = described.select("lang", "lines").mapInPandas(run, "g string, f int, b int, n bigint").groupBy("g", "f", "b").agg(F.sum("n").alias("n")).collect()
    tables: dict[str, np.ndarray] = {}
    for r in counted:
        tables.setdefault(r["g"], np.zeros((len(FEATURES), len(GRID))))[r["f"], r["b"]] += r["n"]
    out = {}
    for g, t in tables.items():
        share = np.cumsum(t, axis=1) / t.sum(axis=1, keepdims=True)
        low, mid, high = (GRID[(share >= q).argmax(axis=1)] for q in (0.25, 0.5, 0.75))
        out[g] = (mid, np.diag(1 / np.maximum((high - low) / 1.349, FLOOR) ** 2))
    return out


def _concentrate(described: DataFrame, models: dict[str, Model], part: float) -> dict[str, Model]:
    """Moments of the ``part`` of the lines closest to the present location, out of moments kept by bins of distance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, x in _matrices(pdf):
                moments = np.concatenate([np.ones((len(x), 1)), x, np.stack([x[:, i] * x[:, j] for i, j in PAIRS], 1)], axis=1)
                for g in _groups(lang):
                    bins = np.searchsorted(BINS, _distance(models[g], x)[0], side="right")
                    np.add.at(acc.setdefault(g, np.zeros((len(BINS) + 1, WIDTH))), bins, moments)
        rows = [(g, int(b), *own[b]) for g, own in acc.items() for b in np.flatnonzero(own[:, 0])]
        yield pd.DataFrame(rows, columns=["g", "b", *[f"m{i}" for i in range(WIDTH)]])

    schema = "g string, b int, " + ", ".join(f"m{i} double" for i in range(WIDTH))
    sums = described.select("lang", "lines").mapInPandas(run, schema).groupBy("g", "b").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(WIDTH)]).collect()
    tables: dict[str, np.ndarray] = {}
    for r in sums:
        tables.setdefault(r["g"], np.zeros((len(BINS) + 1, WIDTH)))[r["b"]] += [r[f"m{i}"] for i in range(WIDTH)]
    out, k = dict(models), len(FEATURES)
    for g, t in tables.items():
        last = int((np.cumsum(t[:, 0]) >= part * t[:, 0].sum()).argmax())
        total = t[: last + 1].sum(axis=0)
        n, mean = total[0], total[1 : k + 1] / total[0]
        scatter = np.zeros((k, k))
        for (i, j), p in zip(PAIRS, total[k + 1 :]):
            scatter[i, j] = scatter[j, i] = p / n - mean[i] * mean[j]
        out[g] = (mean, np.linalg.inv(scatter / part + np.diag(np.square(FLOOR)) / 2))
    return out


def fit(described: DataFrame, steps: int = 3, part: float = 0.5) -> dict[str, Model]:
    """Robust location and inverse scatter per language, and of all languages together for documents in none.

    Equal pages count once: a page copied to a large part of the rows would else become the norm.
    """
    pages = cut(described.where(F.col("lang") != "und").select("lang", "lines", "page").dropDuplicates(["lang", "page"]))
    models = _start(pages)
    for _ in range(steps):
        models = _concentrate(pages, models, part)
    if "und" not in models:
        models["und"] = (np.zeros(len(FEATURES)), np.diag(1 / np.square(FLOOR)))
    return models


def score(documents: DataFrame, key: str = "doc_id", text: str = "text", cutoff: float = 12.0) -> DataFrame:
    """(key, lang, lines, spam_lines) per document with a text: its text lines, and those flagged.

    A line is flagged if its squared distance is over ``cutoff`` and deviations towards spam make up more than half
    of it. Null texts are left out; a text without text lines has 0 of 0. Repeated rows and null keys are scored
    row by row; whole texts of any length are read. Extra columns are not read.
    """
    lines = cut(describe(documents, key, text))
    models = fit(lines)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total, flagged = [], []
            for lang, values in zip(pdf["lang"], pdf["lines"]):
                x = np.asarray(values, dtype=np.float64).reshape(-1, len(FEATURES))
                d, towards = _distance(models.get(lang, models["und"]), x)
                total.append(len(x))
                flagged.append(int(((d > cutoff) & (towards > d / 2)).sum()))
            yield pd.DataFrame({"k": pdf["k"], "lang": pdf["lang"], "lines": total, "spam_lines": flagged})

    kind = documents.schema[key].dataType.simpleString()
    scored = lines.mapInPandas(run, "k string, lang string, lines int, spam_lines int")
    return scored.select(F.col("k").cast(kind).alias(key), "lang", "lines", "spam_lines")


def find(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key), once each: documents more than half of whose text lines are flagged."""
    return score(documents, key, text).where(F.col("spam_lines") * 2 > F.col("lines")).select(key).distinct()
