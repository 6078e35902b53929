"""Broken prompt and response pairs, each labelled with its type of defect.

The openings of all responses are cut into clauses and down to templates (numbers and words shared with the prompt
become slots), which are clustered by verified MinHash. Classes that recur across unrelated prompts show how this
corpus refuses: a small model of what clauses do, trained on a labelled table of its own, is trained again on the
recurring classes it is sure of, and then judges every class by its clauses and its recurrence. An answer is a refusal
if a clause of its opening is of a refusing class and nothing it says has substance; closing phrases are clauses
found mostly behind refusals. Row-local checks for emptiness, copies, language and termination label the other defects;
endings that are plain in lists are settled by how statements end elsewhere in the corpus.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import clauses as clause_model
from weftline.llm import language
from weftline.llm.minhash import cluster
from weftline.operators import nested
from weftline.session import cut

PAIR = "request_id string, prompt_id bigint, marks array<bigint>, defect string, clauses array<string>, opening int, inner array<string>, ends array<string>, open_end string, open_word string, answer_id bigint"
MARKS = 4
SMALL = 100_000  # words that are broadcast; more of them are joined
#: Where a statement has a clause of its own: signs, and words that set a clause against the one before.
JOINT = re.compile(r"[;:–—]\s+|\s-\s|,\s+(?:but|yet|so|aber|doch|jedoch|daher|deshalb|mais|donc|alors|pero|así\s+que|por\s+eso|ma|mas|maar)\s+", re.I)
#: What stands for no answer at all.
NOTHING = frozenset("n/a na null none nil nan empty undefined blank todo tbd noanswer".split())
LABEL = re.compile(r"^\s*[>*\"'«“„(\[]*\s*(?:\w++(?:\s\w++)?\s?:|-)\s*")
BULLET = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)])\s+")
ENDED = frozenset(".?!…:\"'”“»)]}>*`。！？")
NO_LETTER = re.compile(r"[\W_]+")
_NOTHING = frozenset(NO_LETTER.sub("", x) for x in NOTHING)
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def _texts(value: object) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        value = [value]
    if isinstance(value, list):
        parts = [v if isinstance(v, str) else " ".join(x for k in ("text", "refusal") if isinstance(x := v.get(k), str)) for v in value if isinstance(v, (str, dict))]
        return "\n".join(p for p in parts if p)
    return ""


def question_of(params: object) -> str:
    """The text of the last user message, or the prompt, or the input."""
    if not isinstance(params, dict):
        return ""
    for field in ("messages", "input"):
        turns = params.get(field)
        if isinstance(turns, list) and any(isinstance(t, dict) and "role" in t for t in turns):
            for turn in reversed(turns):
                if isinstance(turn, dict) and turn.get("role") == "user":
                    return _texts(turn.get("content"))
            return ""
    return _texts(params.get("prompt")) or _texts(params.get("input"))


def answer_of(response: object) -> tuple[str, bool]:
    """The text of the choice with index 0 or of the output message, refusal fields included, and whether it calls a tool."""
    if not isinstance(response, dict):
        return "", False
    parts: list[str] = []
    calls = False
    if isinstance(response.get("choices"), list):
        for choice in response["choices"]:
            if isinstance(choice, dict) and choice.get("index") == 0:
                message = choice.get("message") if isinstance(choice.get("message"), dict) else {}
                parts += [_texts(choice.get("text")), _texts(message.get("content")), _texts(message.get("refusal"))]
                calls = calls or bool(message.get("tool_calls") or message.get("function_call"))
                break
    elif isinstance(response.get("output"), list):
        for item in response["output"]:
            if isinstance(item, dict):
                kind = item.get("type")
                if kind == "message" or kind is None:
                    parts.append(_texts(item.get("content")))
                elif isinstance(kind, str) and kind.endswith("_call"):
                    calls = True
    return "\n".join(p for p in parts if p), calls


def _letters(text: str) -> str:
    return NO_LETTER.sub("", text.casefold())


def is_empty(answer: str) -> bool:
    core = _letters(answer)
    return not core or core in _NOTHING


def copies(question: str, answer: str) -> bool:
    """Whether the answer is the question once or several times over, labels, case, spacing and punctuation aside."""
    asked = _letters(question)
    if not asked:
        return False
    for text in dict.fromkeys((answer, LABEL.sub("", answer, count=1), "\n".join(LABEL.sub("", line, count=1) for line in answer.split("\n")))):
        said = _letters(text)
        if said and len(said) % len(asked) == 0 and said == asked * (len(said) // len(asked)):
            return True
    return False


def statements(text: str) -> list[str]:
    return [s for line in text.split("\n") for s in re.split(r"(?<=[.?!…])\s+", BULLET.sub("", line).strip()) if WORDS.search(s)]


def _template(statement: str, pairs: set[tuple[str, str]]) -> str:
    """Lower case; numbers, and word pairs that stand in the question too, become slots."""
    words = [("0" if w.isdigit() else w) for w in WORDS.findall(statement.lower())]
    shared = [False] * len(words)
    for i in range(len(words) - 1):
        if (words[i], words[i + 1]) in pairs:
            shared[i] = shared[i + 1] = True
    out: list[str] = []
    for w, s in zip(words, shared):
        if not s:
            out.append(w)
        elif not out or out[-1] != "_":
            out.append("_")
    return " ".join(out)


def clauses(statement: str, pairs: set[tuple[str, str]]) -> list[str]:
    """The templates of a statement's clauses; a clause without words is none."""
    return [t for c in JOINT.split(statement.replace("’", "'")) if (t := _template(c, pairs))]


def _marks(question: str) -> list[int]:
    """MinHash values of the question's words: two questions agree in one as often as they have words in common."""
    words = {hash_of(w) for w in WORDS.findall(question.lower())} or {0}
    # a mask laid over all hashes puts them in another order
    return [min(map(m.__xor__, words)) for m in _MASKS]


def wrong_language(question: str, answer: str, lead: float = 6.0) -> bool:
    """Whether the answer is in a language that is neither the question's nor one the question names."""
    plain = re.sub(r"```.*?(?:```|$)", " ", answer, flags=re.S)
    if not NO_LETTER.sub("", plain).strip("0123456789"):
        return False
    asked, said = language.scores(question), language.scores(plain)
    if not asked or not said:
        return False
    own = max(asked, key=asked.__getitem__)
    allowed = language.named_languages(question) | {own}
    best = max(said, key=said.__getitem__)
    return best not in allowed and said[best] - max(said[a] for a in allowed) > lead


def _parsed(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return nested.parse_deep(text)


def _examine(request_id: str, params: str, response: str) -> tuple | None:
    try:
        asked, got = _parsed(params), _parsed(response)
    except ValueError:
        return None
    question = question_of(asked)
    answer, calls = answer_of(got)
    own = WORDS.findall(question.lower())
    prompt_id, answer_id, marks = hash_of(_letters(question)), hash_of(_letters(answer)), _marks(question)
    if is_empty(answer):
        return (request_id, prompt_id, marks, None if calls else "empty", [], 0, [], [], None, None, answer_id)
    defect = "answer_copies_question" if copies(question, answer) else "other_language" if wrong_language(question, answer) else None
    said = statements(answer)
    if not said:
        return (request_id, prompt_id, marks, defect, [], 0, [], [], None, None, answer_id)
    pairs = set(zip(own, own[1:]))
    # every word that another one follows, with the word before it
    inner: set[str] = set()
    # the opening is the first two statements, as the first may be no more than a courtesy
    parts = []
    for s in said:
        own_clauses = clauses(s, pairs)
        parts.append(own_clauses)
        words = (own_clauses[0] if len(own_clauses) == 1 else _template(s.replace("’", "'"), pairs)).split(" ")
        inner.update(map(" ".join, zip(["", *words], words[:-1])))
    # endings: the last two words of every statement that is closed by a sign, or by the end of its list item
    lines = [line for line in answer.split("\n") if line.strip()]
    last = lines[-1].rstrip()
    ends, open_end, open_word = [], None, None
    for i, line in enumerate(lines):
        closed = line.rstrip()[-1:] in ENDED
        if i < len(lines) - 1 or closed:
            ends += [_last_words(s) for s in statements(line)]
        else:
            ends += [_last_words(s) for s in statements(line)[:-1]]
    if answer.count("```") % 2:
        open_end = "code"
    elif last[-1] not in ENDED and not re.fullmatch(r"[\W\d_]+", last.strip()):
        listed = bool(BULLET.match(last)) and last[-1] not in ",;-–"
        open_end = "item" if listed else "sentence"
        open_word = _last_words(statements(last)[-1]) if statements(last) else ""
    elif last[-1] in ",;":
        open_end = "sentence"
    return (request_id, prompt_id, marks, defect, [c for p in parts for c in p], sum(map(len, parts[:2])), list(inner), ends, open_end, open_word, answer_id)


def _last_words(statement: str) -> str:
    return " ".join(("0" if w.isdigit() else w) for w in WORDS.findall(statement.lower().replace("’", "'"))[-2:])


_MASKS = tuple(pow(7, 11 + 5 * i, (1 << 61) - 1) for i in range(MARKS))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - 2**63


def _examine_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [x for k, p, r in zip(pdf["request_id"], pdf["params"], pdf["response"]) if (x := _examine(k, p, r))]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAIR.split(", ")])


def examine(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per pair with what its own text shows; pairs whose JSON cannot be read are left out."""
    asked = requests.select("request_id", "params").where(F.col("params").isNotNull())
    got = responses.select("request_id", "response").where(F.col("response").isNotNull())
    return asked.join(got, "request_id").mapInPandas(_examine_all, PAIR)


def _probabilities(weights: np.ndarray):
    shared = SparkSession.active().sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(clause_model.probabilities(shared.value, texts.tolist())))

    return run


def _log_odds(p: Column) -> Column:
    return F.log((p + 1e-6) / (1 - p + 1e-6))


def judge_clauses(said: DataFrame, similarity: float = 0.8, sure: float = 0.85, learnt: int = 2_000, weight: float = 0.5, least: float = 0.5) -> DataFrame:
    """(clause, refuses, p_refusal, p_polite): what the clauses of ``said`` (pair columns, marks, clause, opens) do.

    Opening clauses are clustered; a class's recurrence is the number of unrelated prompts it answers (distinct MinHash
    values of their words, the least of several counts, so prompts with most words in common count about once). Up to
    ``learnt`` of the most recurring classes the model is sure of train it again; this bounds the training sample only. A
    class refuses if the log-odds of its clauses and ``weight`` times the logarithm of its recurrence (at most 2)
    make at least ``least``.
    """
    counted = cut(said.groupBy("clause").agg(F.max("opens").alias("opens")))
    classes = cluster(counted.where("opens").select("clause"), "clause", similarity=similarity)
    classes = cut(classes.withColumn("p", _probabilities(clause_model.general())("clause")))
    marks = [F.approx_count_distinct(F.get("marks", F.lit(i))).alias(f"m{i}") for i in range(MARKS)]
    recurring = said.where("opens").join(classes.select("clause", "class_id"), "clause").groupBy("class_id").agg(*marks)
    recurring = cut(recurring.select("class_id", F.least(*[F.col(f"m{i}") for i in range(MARKS)]).alias("prompts")))
    means = [F.avg(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(len(clause_model.CLASSES))]
    per_class = classes.groupBy("class_id").agg(F.min("clause").alias("clause"), *means).join(recurring, "class_id")
    # recurrence speaks for a refusal; what is no refusal must be so by its words alone
    seen = F.lit(weight) * F.least(F.log(F.col("prompts").cast("double")), F.lit(2.0))
    refusal = _log_odds(F.col(f"p{clause_model.REFUSAL}")) + seen >= math.log(sure / (1 - sure))
    label = F.when(refusal, clause_model.REFUSAL)
    for i in (clause_model.COURTESY, clause_model.OTHER):
        label = label.when(F.col(f"p{i}") >= sure, i)
    certain = per_class.where(F.col("prompts") > 1).withColumn("label", label).where(F.col("label").isNotNull())
    sample = certain.orderBy(F.desc("prompts"), "clause").limit(learnt).collect()
    own = [(r["clause"], r["label"]) for r in sample]
    weights = clause_model.train(clause_model.labelled() + own) if own else clause_model.general()
    judged = counted.select("clause", _probabilities(weights)("clause").alias("p"))
    judged = cut(judged.select("clause", F.get("p", F.lit(clause_model.REFUSAL)).alias("p_refusal"), F.get("p", F.lit(clause_model.COURTESY)).alias("p_polite")))
    odds = judged.join(classes.select("clause", "class_id"), "clause").groupBy("class_id").agg(F.avg(_log_odds(F.col("p_refusal"))).alias("odds"))
    refusing = odds.join(recurring, "class_id").where(F.col("odds") + seen >= least).select("class_id")
    refusing = classes.join(refusing, "class_id", "left_semi").select("clause", F.lit(True).alias("refuses"))
    return judged.join(refusing, "clause", "left").withColumn("refuses", F.coalesce("refuses", F.lit(False)))


def refusals_of(pairs: DataFrame, closing_share: float = 0.6, prior: float = 2.0) -> DataFrame:
    """(request_id, prompt_id) of the answers that decline and give nothing else.

    A clause is a closing phrase by its share behind refusals, to which the model's probability that it refuses or is
    polite adds ``prior`` sightings: what is seen often is judged by where it stands, what is seen once by what it is.
    A clause made of nothing but words of the question says nothing of its own.
    """
    said = pairs.select("request_id", "prompt_id", "marks", F.posexplode("clauses").alias("place", "clause"), "opening").withColumn("opens", F.col("place") < F.col("opening"))
    said = said.where(F.col("clause") != "_").drop("place", "opening")
    judged = cut(judge_clauses(said))
    known = said.join(judged, "clause")
    refused = cut(known.where("opens AND refuses").select("request_id", "prompt_id").distinct())
    behind = known.join(refused.withColumn("refused", F.lit(1.0)), ["request_id", "prompt_id"], "left").withColumn("refused", F.coalesce("refused", F.lit(0.0)))
    share = (F.sum("refused") + prior * F.first(F.col("p_refusal") + F.col("p_polite"))) / (F.count(F.lit(1)) + prior)
    closing = behind.groupBy("clause").agg(share.alias("share"), F.first("refuses").alias("refuses")).where((F.col("share") < closing_share) & ~F.col("refuses")).select("clause")
    substance = said.join(refused, ["request_id", "prompt_id"], "left_semi").join(closing, "clause", "left_semi").select("request_id", "prompt_id")
    return refused.join(substance.distinct(), ["request_id", "prompt_id"], "left_anti")


def find(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id, defect), one row per broken pair; a sound pair gives none.

    defect is the first that applies of ``empty``, ``answer_copies_question``, ``refusal``, ``other_language`` and
    ``truncated``. Requests without a response, responses without a request, null JSON and JSON that cannot be
    read are no pairs. A null request_id joins nothing. Repeated ids give the pairs of all their rows, once.
    """
    pairs = cut(examine(requests, responses))
    open_ = pairs.where(F.col("defect").isNull() | (F.col("defect") == "other_language"))
    refusals = refusals_of(open_).withColumn("refusal", F.lit(True))
    # how statements end: pairs of last words, and single last words for pairs not seen elsewhere
    # counted over distinct answers, so that copies of an answer change nothing
    endings = cut(pairs.select("answer_id", F.explode("ends").alias("end")).distinct())
    items = pairs.where(F.col("open_end") == "item").select("request_id", "prompt_id", F.col("open_word").alias("end")).distinct()
    items = cut(items.withColumn("word", F.substring_index("end", " ", -1)))
    word_ends = endings.select("answer_id", F.substring_index("end", " ", -1).alias("word")).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("word_ends"))
    # a pair goes on if a word follows it, as does a word; an item's own last words do not
    inner = pairs.select("answer_id", F.explode("inner").alias("end")).withColumn("word", F.substring_index("end", " ", -1))
    asked_of = cut(items.select("word").distinct())
    if asked_of.limit(SMALL + 1).count() <= SMALL:
        asked_of = F.broadcast(asked_of)
    inner = cut(inner.join(asked_of, "word", "left_semi").distinct())
    pair_inner = inner.select("end").distinct().withColumn("goes_on", F.lit(True))
    word_inner = inner.select("answer_id", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("word_inner"))
    settled = (
        items.join(endings.select("end").distinct().withColumn("ends", F.lit(True)), "end", "left").join(pair_inner, "end", "left")
        .join(word_ends, "word", "left").join(word_inner, "word", "left")
        .withColumn("mostly", F.col("goes_on").isNull() | (F.col("word_ends") >= F.coalesce(F.col("word_inner"), F.lit(0))))
        .withColumn("whole", F.col("ends").isNotNull() | (F.col("word_ends").isNotNull() & F.col("mostly")))
        .select("request_id", "prompt_id", "whole")
    )
    judged = pairs.select("request_id", "prompt_id", "defect", "open_end").join(refusals, ["request_id", "prompt_id"], "left").join(settled.distinct(), ["request_id", "prompt_id"], "left")
    defect = (
        F.when(F.col("defect").isin("empty", "answer_copies_question"), F.col("defect"))
        .when(F.col("refusal"), "refusal")
        .when(F.col("defect").isNotNull(), F.col("defect"))
        .when(F.col("open_end").isin("code", "sentence") | ((F.col("open_end") == "item") & ~F.coalesce(F.col("whole"), F.lit(False))), "truncated")
    )
    return judged.select("request_id", defect.alias("defect")).where(F.col("defect").isNotNull()).distinct()

