import re
from collections import Counter
from pathlib import Path

import pytest

from weftline.llm import pii, pii_labels

DATA = Path("/root/testdata/sf0.01/requests.parquet")


SLOTS = {
    "P": r"[+(]?\d[\d ()/.+-]{5,25}", "I": r"[A-Za-z]{0,2}[ -]?\d[\d .-]{5,22}[A-Za-z]?", "E": r"\S+ ?(?:@|[\[(]at[\])]) ?\S+", "N": r"[A-ZÀ-Ü][^\n.!?]{2,40}?", "A": r"(?=[^\n]{0,50}\d)[^\n]{4,60}?",
    "T": r"[A-ZÀ-Ü]\w+", "G": r"[A-ZÀ-Ü]\w+", "Z": r"\d{4,5}", "x": r"(?=[^\n]{0,20}[\d@])[^\n]{4,40}?", "title": r"(?:Mr|Mrs|Ms|Dr|Miss|Herrn|Frau|M|Mme|Mlle|Sr|Sra|D|Dña)\.?(?: Dr\.)?",
}


def _literal(text):
    return "".join(SLOTS.get(q[1:-1], r"\d+") if re.fullmatch(r"\{\w+\}", q) else re.escape(q) for q in re.split(r"(\{\w+\})", text))


def _pattern(frame):
    """A frame as a pattern over its choices and slots; any ending goes where the frame has some."""
    parts = re.split(r"(\[[^\[\]]*\])", frame.replace("\\n", "\n").rstrip(". "))
    out = "".join("(?:" + "|".join(_literal(c) for c in part[1:-1].split("|")) + ")" if part[:1] == "[" else _literal(part) for part in parts)
    return re.compile(r"(?:^|(?<=[.?!\n] )|(?<=\n))" + out.replace(r"\ ", " ?").strip() + r"(?=$|\W)", re.M)


def test_no_frame_stands_in_the_data():
    if not DATA.exists():
        pytest.skip("no test data")
    import pandas as pd

    whole = "\n".join({t for b in pd.read_parquet(DATA)["request_body"].dropna() for _, _, t in pii.literals(b)})
    hits = {}
    for part in ("personal", "plain"):
        for own in pii_labels.frames(part).values():
            for frame in own:
                # a frame of slots only has no words of its own
                if re.search(r"[^\W\d_]", re.sub(r"\{\w+\}|\\\\n", "", frame)) and (m := _pattern(frame).search(whole)):
                    hits[frame] = m.group()
    assert not hits, hits


@pytest.fixture(scope="module")
def scores():
    """Per type (right, wrong, missed) where every eighth frame is unknown to the model, and all values are."""
    right, wrong, missed = Counter(), Counter(), Counter()
    for fold in (0, 3, 5):
        model = pii.trained(frozenset({"anna", "peter", "rose"}), frozenset({"king"}), fold=(-fold - 1, 8))
        table = pii_labels.labelled_table(copies=3, seed=99, fold=(fold, 8), strange=False)
        texts = ["".join(p for p, _ in t) for t in table]
        for pieces, spans, text in zip(table, pii.spans(*model, texts), texts):
            want = {(k, pii.key_of(p)) for p, k in pieces if k}
            got = {(k, pii.key_of(text[a:b])) for k, a, b in spans}
            right.update(k for k, _ in want & got)
            wrong.update(k for k, _ in got - want)
            missed.update(k for k, _ in want - got)
    return {k: (right[k], wrong[k], missed[k]) for k in pii.TYPES}


def test_frames_the_model_has_not_seen(scores):
    print({k: (round(a / (a + b), 3), round(a / (a + c), 3)) for k, (a, b, c) in scores.items()})
    total = [sum(x[i] for x in scores.values()) for i in range(3)]
    assert total[0] / (total[0] + total[1]) > 0.85 and total[0] / (total[0] + total[2]) > 0.85
    for kind, (a, b, c) in scores.items():
        assert a / (a + b) > 0.7 and a / (a + c) > 0.65, (kind, a, b, c)
