import random

from weftline.llm.minhash import cluster


def brute(texts):
    def runs(t):
        w = t.split(" ")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    texts = sorted(set(texts))
    up = {t: t for t in texts}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            x, y = runs(a), runs(b)
            if len(x & y) / len(x | y) >= 0.8:
                up[root(a)] = root(b)
    classes = {}
    for t in texts:
        classes.setdefault(root(t), set()).add(t)
    return sorted(map(sorted, classes.values()))


def test_classes_against_all_pairs(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(40)]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            copy[r.choice([0, 39])] = "other"
            texts.append(" ".join(copy))
    texts += ["short", "short", "", "a b"]
    got = {}
    for row in cluster(spark.createDataFrame([(t, 1) for t in texts] + [(None, 1)], "text string, id int"), "text").collect():
        got.setdefault(row.class_id, set()).add(row.text)
    assert sorted(map(sorted, got.values())) == brute(texts)
    assert cluster(spark.createDataFrame([], "text string"), "text").count() == 0


def test_no_link_of_a_chain_is_lost(spark):
    r = random.Random(3)
    texts = []
    for c in range(100):
        chain = [[f"w{r.randrange(1000)}" for _ in range(40)]]
        for step in range(5):  # neighbours are similar, ends are not
            chain.append(list(chain[-1]))
            chain[-1][(2, 37, 1, 38, 0)[step]] = f"n{c}_{step}"
        texts += [" ".join(x) for x in chain]
    got = {}
    for row in cluster(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect():
        got.setdefault(row.class_id, set()).add(row.text)
    assert sorted(map(sorted, got.values())) == brute(texts)
    assert len(got) == 100
