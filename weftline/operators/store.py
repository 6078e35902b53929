"""Keyed records: look-up, tag selection, paging, upsert, patch, delete, and versions on disk."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import fresh


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id", place: str = "place") -> DataFrame:
    """The rows of the listed keys in the order of the list: repeated keys repeat, unknown keys are dropped.

    ids has the key and its place in the list; a large list is joined, not filtered by value.
    """
    return ids.select(place, key).join(rows, key).orderBy(place)


def not_found(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """(key, message) for every listed key that no row has."""
    return ids.select(key).distinct().join(rows.select(key), key, "left_anti").withColumn("message", F.concat(F.lit("not found: "), F.coalesce(key, F.lit(""))))


def by_tags(rows: DataFrame, wanted: Sequence[str], every: bool, tags: str = "tags") -> DataFrame:
    """Rows that carry every wanted tag, or any; no wanted tags select nothing, null tags are never selected."""
    if not wanted:
        return rows.where(F.lit(False))
    asked = F.array(*[F.lit(t) for t in wanted])
    hit = F.size(F.array_except(asked, F.col(tags))) == 0 if every else F.arrays_overlap(F.col(tags), asked)
    return rows.where(F.col(tags).isNotNull() & hit)


def page(rows: DataFrame, order: list[Column], limit: int, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the page, its envelope): a declared order, an offset, and one row of look-ahead that tells whether more follow.

    The envelope has first and last id ('' for an empty page) and has_more. An offset sorts and skips all rows before
    it; from page to page page_after reads on from a cursor.
    """
    fetched = rows.orderBy(*order).offset(start).limit(limit + 1)
    return fetched.limit(limit), _envelope(fetched, order, limit)


def _envelope(fetched: DataFrame, order: list[Column], limit: int) -> DataFrame:
    # at most limit + 1 rows, in one partition
    (at,) = fresh(fetched, "at")
    numbered = fetched.withColumn(at, F.row_number().over(Window.orderBy(*order)))
    own = F.col(at) <= limit
    return numbered.agg(
        F.coalesce(F.min_by(F.when(own, F.col("id")), F.when(own, F.col(at))), F.lit("")).alias("first_id"),
        F.coalesce(F.max_by(F.when(own, F.col("id")), F.when(own, F.col(at))), F.lit("")).alias("last_id"),
        (F.count(F.lit(1)) > limit).alias("has_more"),
    )


def cursor_of(row: Row, keys: Sequence[str]) -> str:
    """An opaque text that says where a page ended."""
    return base64.urlsafe_b64encode(json.dumps([row[k] for k in keys], separators=(",", ":")).encode()).decode().rstrip("=")


def _position(cursor: str, n: int) -> list:
    try:
        position = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (ValueError, UnicodeDecodeError) as e:
        raise ValueError("not a cursor of this list") from e
    if not isinstance(position, list) or len(position) != n:
        raise ValueError("not a cursor of this list")
    return position


def page_after(rows: DataFrame, keys: Sequence[str], limit: int, cursor: str | None = "") -> tuple[DataFrame, str | None]:
    """(the next page in ascending order of ``keys``, nulls first, and the cursor after it).

    The cursor holds the keys of the last row, so the next page is a filter and a top-k, however far on it is. Keys
    are texts, numbers or booleans; together they should be unique, as rows equal in all of them to the last one of a
    page do not come again. '' asks for the first page; the cursor is null once no row follows, and a null cursor gives an
    empty page. One that was made for other keys raises ValueError.
    """
    if cursor is None:
        return rows.limit(0), None
    after = F.lit(True)
    if cursor:
        after, equal = F.lit(False), F.lit(True)
        for k, v in zip(keys, _position(cursor, len(keys))):
            beyond = F.col(k).isNotNull() if v is None else F.col(k) > F.lit(v)
            after = after | (equal & beyond)
            equal = equal & F.col(k).eqNullSafe(F.lit(v))
    fetched = rows.where(F.coalesce(after, F.lit(False))).orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(limit + 1)
    ends = fetched.select(*keys).collect()  # at most limit + 1 rows of the keys
    own = fetched.limit(limit)
    return own, cursor_of(ends[limit - 1], keys) if len(ends) > limit else None


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace stored rows of their key; new must hold a key once."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def patch(stored: DataFrame, patches: DataFrame, fields: Sequence[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(stored rows with non-empty patch values put in, keys of patches that meet no row).

    Only the named dynamic fields change, and only to values that are not null, blank or an empty list.
    """
    renamed = patches.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = stored.join(renamed, F.col(key) == F.col("__key"), "left")
    for f in fields:
        new = F.col(f"__{f}")
        kind = patches.schema[f].dataType.typeName()
        set_ = new.isNotNull() & (F.size(new) > 0 if kind in ("array", "map") else new != "" if kind == "string" else F.lit(True))
        joined = joined.withColumn(f, F.when(set_, new).otherwise(F.col(f)))
    return joined.select(*stored.columns), patches.select(key).join(stored.select(key), key, "left_anti")


def delete(stored: DataFrame, ids: DataFrame, key: str = "id", place: str = "place") -> tuple[DataFrame, DataFrame]:
    """(what is left, the keys that were there, each once, in the order of their first mention)."""
    gone = ids.groupBy(key).agg(F.min(place).alias(place)).join(stored.select(key).distinct(), key, "left_semi").orderBy(place)
    return stored.join(ids.select(key), key, "left_anti"), gone


class Versions:
    """A table kept as version folders and a pointer; a version is never overwritten while it may be read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str = "CURRENT"):
        return self._path(f"{self.path}/{name}")

    def current(self) -> str | None:
        if not self._fs.exists(self._pointer()):
            return None
        # a pointer is one line, so reading it as text costs one small task
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0]

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, rows: DataFrame, *partitions: str) -> str:
        """Write a new version, then move the pointer to it."""
        version = f"v-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partitions).parquet(f"{self.path}/{version}")
        out = self._fs.create(self._pointer("NEXT"), True)
        out.write(bytearray(version.encode()))
        out.close()
        if self._fs.exists(self._pointer()):
            self._fs.delete(self._pointer(), False)
        if not self._fs.rename(self._pointer("NEXT"), self._pointer()):
            raise OSError(f"the pointer of {self.path} could not be moved")
        return version

    def clear(self, keep: int = 0) -> int:
        """Remove all versions but the current one and the ``keep`` youngest before it; gives how many went.

        Without a pointer everything goes. Whoever still reads a removed version will fail, so keep as many as readers need.
        """
        now = self.current()
        base = self._path(self.path)
        if not self._fs.exists(base):
            return 0
        found = [(f.getModificationTime(), f.getPath()) for f in self._fs.listStatus(base) if f.isDirectory() and f.getPath().getName().startswith("v-")]
        old = sorted((f for f in found if f[1].getName() != now), key=lambda f: -f[0])
        for _, path in old[keep if now else 0 :]:
            self._fs.delete(path, True)
        return len(old[keep if now else 0 :])

    def close(self) -> None:
        """Remove the table with all its versions."""
        self._fs.delete(self._path(self.path), True)
