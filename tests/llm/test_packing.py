import random
from collections import Counter, defaultdict

import pytest

from weftline.llm import packing


def least(items, capacity):
    """The least number of containers, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[j] -= items[i]
            go(i + 1, rooms)
            rooms[j] += items[i]
        rooms.append(capacity - items[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(6))
def test_reduction_loses_nothing(seed):
    r = random.Random(seed)
    for _ in range(120):
        capacity = r.choice([10, 30, 100])
        items = [r.randint(max(1, capacity // 8), capacity) for _ in range(r.randint(1, 9))]
        fixed, rest = packing.reduce_instance(dict(Counter(items)), capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(t for t, _ in fixed) + least(left, capacity) == least(items, capacity)
        runs = packing.solve(dict(Counter(items)), capacity)
        assert all(sum(s * n for s, n in f) <= capacity for _, f in runs)
        assert Counter(s for t, f in runs for s, n in f for _ in range(t * n)) == Counter(items)


def test_frames(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, 0, 5, 100, 101, 250, r.randint(1, 100), 37, 37, 37]), "x") for i in range(800)] + [(1, 37, "x"), (None, 37, "x"), (None, 37, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, container string")
    profiles = spark.createDataFrame([("s", 100), ("m", 256), (None, 5), ("zero", 0)], "profile string, capacity_tokens int")
    for limit in (1_000_000, 50):
        got = packing.pack(docs, profiles, slice_rows=limit).collect()
        for profile, capacity in (("s", 100), ("m", 256)):
            own = [x for x in got if x.profile == profile]
            load, whole, parts = Counter(), Counter(), defaultdict(set)
            for x in own:
                assert (x.container is None) == (x.tokens == 0)
                load[x.container] += x.tokens
                whole[x.doc_id] += x.tokens
                parts[x.doc_id].add(x.piece)
            assert max(v for k, v in load.items() if k is not None) <= capacity
            assert set(load) - {None} == set(range(len(set(load) - {None})))
            want = Counter()
            for i, n, _ in rows:
                want[i] += n or 0
            assert +whole == +want
            assert all(len(p) == 1 for i, p in parts.items() if i is not None and (rows[i][1] or 0) <= capacity)
            total = sum(load.values())
            assert len(set(load) - {None}) <= -(-total // capacity) * 1.05 + 1
    report = {x.profile: x for x in packing.fill_report(packing.pack(docs, profiles), profiles).collect()}
    assert report["s"].containers >= report["s"].least_containers and 0.9 < report["s"].filled <= 1
    assert packing.pack(docs.limit(0), profiles).count() == 0 and packing.pack(docs, profiles.limit(0)).count() == 0


def test_tokens(spark):
    from weftline.llm.queries import TOKENIZER
    from weftline.llm.tokens import count_tokens, encoder

    with open(TOKENIZER, "rb") as f:
        own = encoder(f.read())
    texts = ["", "hello world", "Straße 12 – ok\n\n", None, "w" * 100_000, "<|endoftext|>"]
    got = count_tokens(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), tokenizer=TOKENIZER).orderBy("i").collect()
    assert [x.tokens for x in got] == [len(own.encode_ordinary(t)) if t else 0 for t in texts]
    assert all(own.decode(own.encode_ordinary(t)) == t for t in texts if t)
