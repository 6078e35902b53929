"""References to records that do not exist, found by a cascade down the foreign-key graph.

Direct orphans are references whose target is missing, was deleted before, or arrived after the moment of the
reference. Rows that refer to an orphaned row are orphans by inheritance; semi-joins with the rows found in the
previous round follow every edge of the graph until a round finds nothing new (so cycles end too).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

BLANKS = " \t\n"  # fixed: the white space around a reference that does not count


@dataclass(frozen=True)
class Edge:
    """child.field refers to parent.key, at the moment ``at`` (epoch seconds, or None if time plays no part).

    row tells the child's rows apart; it need not be the key they are referred to by.
    """

    child: str
    field: str
    parent: str
    ref: Column
    row: Column
    at: Column | None = None


@dataclass(frozen=True)
class Parent:
    """Key of a table that is referred to, with the epoch seconds its rows arrive and are deleted at."""

    key: Column
    arrived: Column | None = None
    deleted: Column | None = None


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def lifetimes(rows: DataFrame, parent: Parent) -> DataFrame:
    """(parent_key, arrived, deleted): one row per key, the least non-null of each time."""
    none = F.lit(None).cast("bigint")
    return (
        rows.select(parent.key.alias("parent_key"), (none if parent.arrived is None else parent.arrived).alias("arrived"), (none if parent.deleted is None else parent.deleted).alias("deleted"))
        .where(F.col("parent_key").isNotNull())
        .groupBy("parent_key")
        .agg(F.min("arrived").alias("arrived"), F.min("deleted").alias("deleted"))
    )


def references(rows: DataFrame, edge: Edge, own_key: Column | None = None) -> DataFrame:
    """(table_name, row_key, own_key, field, parent, ref, at): the non-blank references along one edge, blanks around them removed.

    own_key is the key other rows refer to this one by, where there is any.
    """
    at = F.lit(None).cast("bigint") if edge.at is None else edge.at
    own = F.lit(None).cast("string") if own_key is None else own_key.cast("string")
    return rows.select(
        F.lit(edge.child).alias("table_name"), edge.row.cast("string").alias("row_key"), own.alias("own_key"), F.lit(edge.field).alias("field"), F.lit(edge.parent).alias("parent"),
        F.btrim(edge.ref, F.lit(BLANKS)).alias("ref"), at.cast("bigint").alias("at"),
    ).where(F.col("ref").isNotNull() & (F.col("ref") != ""))


def direct(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """The references whose target is missing, else deleted at or before the reference, else arrived after it.

    Where the moment of the reference or the target's time is null, only a missing target can be told.
    """
    kind = (
        F.when(F.col("parent_key").isNull(), "missing")
        .when(F.col("deleted") <= F.col("at"), "deleted")
        .when(F.col("arrived") > F.col("at"), "late")
    )
    return refs.join(lives, F.col("ref") == F.col("parent_key"), "left").withColumn("orphan_kind", kind).where(F.col("orphan_kind").isNotNull()).drop("parent_key", "arrived", "deleted")


def cascade(tables: Mapping[str, DataFrame], edges: list[Edge], parents: Mapping[str, Parent]) -> DataFrame:
    """(table_name, row_key, field, ref, at, orphan_kind, inherited, depth) of every orphan reference.

    Direct orphans have depth 0. A reference to an orphaned row inherits its state (orphan_kind ``inherited``) unless it
    is a direct orphan itself; every row is followed once, through whatever fields it is orphaned. Null and blank references
    are none. References equal in row, field, target and moment are one case, so give every row a key of its own.
    A key is orphaned if any row that carries it is. Empty tables are allowed.
    """
    # all references once, in narrow columns; each round reads only those to the tables it comes from
    refs = cut(_union([references(tables[e.child], e, parents[e.child].key if e.child in parents else None) for e in edges]))
    found = _union([direct(refs.where(F.col("parent") == name), lifetimes(tables[name], p)) for name, p in parents.items()])
    # equal references are folded where they are few: among the orphans
    found = cut(found.distinct().withColumn("inherited", F.lit(False)).withColumn("depth", F.lit(0)))
    rounds, depth = [found], 0
    followed = {e.parent for e in edges} & {e.child for e in edges}
    seen: DataFrame | None = None
    same = ["table_name", "row_key", "field", "ref"]
    while True:
        depth += 1
        lost = rounds[-1].where(F.col("table_name").isin(*followed) & F.col("own_key").isNotNull()).select(F.col("table_name").alias("parent"), F.col("own_key").alias("ref")).distinct()
        lost = lost if seen is None else lost.join(seen, ["parent", "ref"], "left_anti")
        lost = cut(lost)
        reached = [r["parent"] for r in lost.select("parent").distinct().collect()]  # names of tables
        if not reached:
            break
        seen = lost if seen is None else seen.unionByName(lost)
        new = refs.where(F.col("parent").isin(*reached)).join(lost, ["parent", "ref"], "left_semi").join(found.select(*same), same, "left_anti")
        rounds.append(cut(new.distinct().select(*refs.columns, F.lit("inherited").alias("orphan_kind"), F.lit(True).alias("inherited"), F.lit(depth).alias("depth"))))
    return _union(rounds).drop("own_key", "parent")


def report(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, UTC day of the reference and kind; the day is null where no moment is known."""
    day = F.date_from_unix_date(F.floor(F.col("at") / 86400).cast("int"))
    return orphans.groupBy("table_name", "field", day.alias("day"), "orphan_kind", "inherited").agg(F.count(F.lit(1)).alias("orphans"))
