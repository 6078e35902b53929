"""Near-duplicate classes of short texts by MinHash, every link verified by the exact similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut


def shingles(text: Column, words: int = 5) -> Column:
    """Hashes of all runs of ``words`` words; of a shorter text the whole as one run."""
    w = F.split(text, " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " ")))
    return F.array_distinct(runs)


def _least(runs: Column, seed: int) -> Column:
    return F.array_min(F.transform(runs, lambda x: F.xxhash64(x, F.lit(seed))))


def _signature(runs: Column, hashes: int) -> Column:
    return F.array(*[_least(runs, seed) for seed in range(hashes)])


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _closed(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, class_id) closed over links (id, other): the least label is passed on until nothing changes.

    In each round every text takes the least label among its neighbours, and then the label of the text its label names, so
    that the rounds grow with the logarithm of the longest chain.
    """
    both = cut(links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    if both.isEmpty():
        return labels
    while True:
        offered = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("class_id").alias("offered"))
        taken = cut(labels.join(offered, "id", "left").select("id", F.least("class_id", "offered").alias("new"), "class_id"))
        named = taken.select(F.col("id").alias("named"), F.col("new").alias("further"))
        new = cut(taken.join(named, F.col("new") == F.col("named"), "left").select("id", F.least("new", "further").alias("new"), "class_id"))
        changed = not new.where(F.col("new") < F.col("class_id")).isEmpty()
        labels = new.select("id", F.col("new").alias("class_id"))
        if not changed:
            return labels


def _links_between(base: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(id, other) as class labels: all pairs of classes with a pair of texts at least ``similarity`` alike.

    With the runs of every text in one order, rarest first, two texts so alike share a run among the first few of
    each, so only those are joined; what is left of both from there on bounds what they can share.
    """
    runs = base.select("id", F.explode("runs").alias("run"))
    ranked = runs.join(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "run").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "run"))).alias("ranked"))
    size = F.size("ranked")
    first = F.slice("ranked", F.lit(1), size - F.ceil(size * F.lit(similarity) - F.lit(1e-6)).cast("int") + 1)
    placed = ranked.join(labels, "id").select("id", "class_id", size.alias("size"), F.posexplode(first).alias("place", "r"))
    # a run found in one text needs no partner, nor does one found in one class only
    placed = cut(placed.where(F.col("r.n") > 1).select("id", "class_id", F.col("r.run").alias("run"), (F.col("size") - F.col("place")).alias("rest"), "size"))
    mixed = placed.groupBy("run").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where(F.col("low") < F.col("high")).select("run")
    placed = placed.join(mixed, "run", "left_semi")
    a, b = placed.alias("a"), placed.alias("b")
    shared = F.least("a.rest", "b.rest") >= (F.col("a.size") + F.col("b.size")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    tried = a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.class_id") < F.col("b.class_id")) & shared)
    tried = tried.select(F.col("a.id").alias("x"), F.col("a.class_id").alias("id"), F.col("b.id").alias("y"), F.col("b.class_id").alias("other")).distinct()
    left, right = base.select(F.col("id").alias("x"), F.col("runs").alias("x_runs")), base.select(F.col("id").alias("y"), F.col("runs").alias("y_runs"))
    return tried.join(left, "x").join(right, "y").where(jaccard(F.col("x_runs"), F.col("y_runs")) >= similarity).select("id", "other").distinct()


def cluster(texts: DataFrame, text: str, words: int = 5, similarity: float = 0.8, bands: int = 10, rows: int = 3) -> DataFrame:
    """(text, class_id) for every distinct non-null text; class_id is the least text hash of its class.

    Texts that share a band are compared with the band's leader, the one of the least hash, which gathers most of a
    class at a cost in proportion to its size. Then all texts of different classes that can be similar are compared,
    so no link is lost, whatever the bands miss. Classes are closed over all links.
    """
    base = cut(texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct().withColumn("id", F.xxhash64("text")).withColumn("runs", shingles(F.col("text"), words)))
    marked = base.withColumn("signature", _signature(F.col("runs"), bands * rows))
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.get("signature", F.lit(b * rows + r)) for r in range(rows)]) for b in range(bands)])
    banded = cut(marked.select("id", "runs", F.explode(keys).alias("band")))
    # a text alone in its band has nothing to be compared with, so its band gets no leader
    leaders = banded.groupBy("band").agg(F.min(F.struct("id", "runs")).alias("leader"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    tried = banded.join(leaders, "band").where((F.col("id") != F.col("leader.id")) & (jaccard(F.col("runs"), F.col("leader.runs")) >= similarity))
    labels = cut(_closed(base.select("id", F.col("id").alias("class_id")), tried.select("id", F.col("leader.id").alias("other"))))
    between = cut(_links_between(base, labels, similarity))
    if not between.isEmpty():
        classes = between.select("id").unionByName(between.select(F.col("other").alias("id"))).distinct()
        joined = _closed(classes.select("id", F.col("id").alias("class_id")), between).select(F.col("id").alias("class_id"), F.col("class_id").alias("least"))
        labels = labels.join(joined, "class_id", "left").select("id", F.coalesce("least", "class_id").alias("class_id"))
    return base.select("id", F.col("text").alias(text)).join(labels, "id").drop("id")
