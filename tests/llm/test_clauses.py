from pathlib import Path

import numpy as np
import pytest

from weftline.llm import clauses, pairs
from weftline.llm.refusal_labels import labelled_clauses

#: Worded by hand, none of them in the labelled table.
REFUSALS = """
I'd rather not get into that topic
I'm going to have to turn you down on this
That is a line I won't cross
Answering this is not something I'm prepared to do
I have been told not to speak about this subject
I am afraid helping with that is off the table for me
Je ne répondrai pas à cette demande
Je regrette mais je ne peux pas traiter cette question
On ne m'autorise pas à parler de cela
Darauf kann ich Ihnen keine Antwort geben
Bei so etwas darf ich nicht helfen
Ich möchte mich zu diesem Thema nicht äußern
No estoy autorizado a hablar de ese asunto
Tengo que negarme a responder
Lamentablemente no puedo darte esa información
"""
OTHERS = """
I cannot help but notice that the soil drains better
It ranges between 4 and 6 litres
I can't think of a quicker fix than a new seal
You can't answer that without a scale
The request log fills up after a week
I was told the parcel would come on Monday
My rule is to measure twice
Man kann den Deckel nicht ohne Werkzeug öffnen
Der Antrag wird nach zwei Wochen beantwortet
Das hilft nicht gegen Rost
On ne peut pas ouvrir le couvercle sans outil
Cette règle vaut pour toutes les pièces
No se puede abrir la tapa sin herramienta
La respuesta llega en dos semanas
Sure, it takes two days
"""


def _templates(text):
    return [pairs.clauses(line, set())[-1] for line in text.strip().split("\n")]


def test_wordings_outside_the_table():
    table = {c for c, _ in labelled_clauses()}
    for text, refuses in ((REFUSALS, True), (OTHERS, False)):
        own = _templates(text)
        assert not table & set(own)
        p = clauses.probabilities(clauses.general(), own)[:, clauses.REFUSAL]
        right = (p > 0.5) == refuses
        assert right.mean() >= 0.9, [(c, round(x, 2)) for c, x, ok in zip(own, p, right) if not ok]


def test_held_out_frames(monkeypatch):
    """Whole frames are held out: every fifth, in turn."""
    from weftline.llm import refusal_labels

    whole = {k: v.strip().split("\n") for k, v in refusal_labels.FRAMES.items()}
    hits = total = 0
    for fold in range(5):
        monkeypatch.setattr(refusal_labels, "FRAMES", {k: "\n".join(f for i, f in enumerate(v) if i % 5 != fold) for k, v in whole.items()})
        weights = clauses.train(clauses.labelled())
        monkeypatch.setattr(refusal_labels, "FRAMES", {k: "\n".join(f for i, f in enumerate(v) if i % 5 == fold) for k, v in whole.items()})
        own = refusal_labels.labelled_clauses(draws=6, seed=77)
        p = clauses.probabilities(weights, [c for c, _ in own])[:, clauses.REFUSAL]
        hits += int(((p > 0.5) == np.array([k == "refusal" for _, k in own])).sum())
        total += len(own)
    assert hits / total > 0.85, hits / total


def test_no_labelled_refusal_stands_in_the_data():
    path = Path("/root/testdata/sf0.01/inference_responses.parquet")
    if not path.exists():
        pytest.skip("no test data")
    import pandas as pd

    table = {c for c, k in labelled_clauses() if k == "refusal" and len(c.split()) >= 4}
    for text in pd.read_parquet(path)["response"]:
        answer, _ = pairs.answer_of(pairs._parsed(text))
        assert not table & {c for s in pairs.statements(answer) for c in pairs.clauses(s, set())}


def test_clauses_of_a_statement():
    assert pairs.clauses("I’m sorry, but I can't say; ask 3 others", set()) == ["i'm sorry", "i can't say", "ask 0 others"]
    assert pairs.clauses("— !", set()) == [] and pairs.clauses("About soil drainage: no", {("soil", "drainage")}) == ["about _", "no"]
