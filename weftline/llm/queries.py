"""Queries p6 to p10, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import mixing, packing, pairs, pii, spam
from weftline.llm.tokens import count_tokens
from weftline.session import cut
from weftline.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # the vocabulary file these queries count with


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "requests"), table(spark, d, "name_list"))


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.mask(table(spark, d, "requests").select("row_seq", "request_id", "request_body"), table(spark, d, "name_list")).drop("request_body")


def p6_masked_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether masking left every body a body: nulls stay null, JSON stays JSON, anything else stays what it was."""
    masked = pii.mask(table(spark, d, "requests").select("row_seq", "request_body"), table(spark, d, "name_list"))
    return masked.select("row_seq", F.col("masked_body").isNull().alias("is_null"), F.try_parse_json("masked_body").isNotNull().alias("is_json"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find(table(spark, d, "inference_requests"), table(spark, d, "inference_responses"))


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return cut(count_tokens(table(spark, d, "documents").select("doc_id", "text"), tokenizer=TOKENIZER))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_lengths(spark, d), table(spark, d, "pack_profiles"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per profile what must hold of any packing: all tokens placed, nothing over the capacity, only long documents split."""
    lengths, profiles = _lengths(spark, d), table(spark, d, "pack_profiles")
    packed = cut(packing.pack(lengths, profiles).join(F.broadcast(profiles), "profile"))
    loads = packed.where("container is not null").groupBy("profile", "container").agg((F.sum("tokens") > F.first("capacity_tokens")).alias("over"))
    loads = loads.groupBy("profile").agg(F.count_if("over").alias("over_capacity"), (F.max("container") + 1 == F.count(F.lit(1))).alias("numbered"))
    documents = packed.groupBy("profile", "doc_id").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.first("capacity_tokens").alias("c"))
    kept = lengths.join(documents, "doc_id").groupBy("profile").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.abs(F.col("tokens") - F.col("placed"))).alias("tokens_missing"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("c"))).alias("split_wrongly")
    )
    return loads.join(kept, "profile").select("profile", "documents", "tokens_missing", "split_wrongly", "over_capacity", "numbered")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), table(spark, d, "pack_profiles"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    documents = table(spark, d, "documents").select("doc_id", "source", "text").withColumn("own_text", F.col("text"))
    return mixing.mix(count_tokens(documents, "own_text", tokenizer=TOKENIZER), targets)


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per source what must hold of the mixture: all its documents looked at, none over its repeats, its share reached.

    A share is reached within half a percent, or as nearly as its documents, which are never cut, allow.
    """
    targets = table(spark, d, "mix_targets")
    mixed = cut(_mixed(spark, d))
    own = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most"), F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least"))
    there = targets.join(own, "source")
    all_ = Window.partitionBy(F.lit(0))  # one row per source
    wanted = F.sum("t").over(all_) * F.col("target_share") / F.sum("target_share").over(all_)
    off = F.abs(F.col("t") - F.col("wanted"))
    reached = (off <= 0.005 * F.col("wanted")) | (off <= F.col("least") / 2)
    return there.withColumn("wanted", wanted).select("source", "documents", (F.col("most") > F.col("max_repeats")).alias("over_repeats"), reached.alias("reached"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixed(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.find(table(spark, d, "documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.score(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_found, p6_masked, p6_masked_check, p7_found, p8_packing, p8_report, p8_invariants, p9_mixture, p9_shares, p9_invariants, p10_found, p10_scores)}

SQL: dict[str, str] = {
    "p6_masked_check": "SELECT row_seq, request_body IS NULL AS is_null, coalesce(json_valid(request_body), false) AS is_json FROM requests",
    "p8_invariants": "SELECT profile, count(*) AS documents, 0::BIGINT AS tokens_missing, 0::BIGINT AS split_wrongly, 0::BIGINT AS over_capacity, true AS numbered FROM pack_profiles, documents GROUP BY profile",
    "p9_invariants": "SELECT source, count(*) AS documents, false AS over_repeats, true AS reached FROM documents WHERE source IN (SELECT source FROM mix_targets) GROUP BY source",
}
