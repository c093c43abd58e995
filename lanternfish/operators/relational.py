"""Keyed writes, resumption and assignment, as operators on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternfish.session import cut, release


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def insert_ignore(target: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of the batch that are new, the first of each key: what INSERT OR IGNORE adds. Rows of known keys are dropped before the sort."""
    return first_per(batch.join(target.select(key), key, "left_anti"), [key], order)


def insert_unique(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], most_rounds: int = 50) -> DataFrame:
    """Rows of the batch that INSERT OR IGNORE adds to a table with several unique keys, one after the other in the given order, whose columns tell all rows apart. Null is no key.

    A row is added if no row added before it, or held by the table, shares one of its keys. In a round the rows that come first in all their keys are added, and those that share a key with these fall
    out; every round settles the first row of each key, and few are needed. Rounds beyond ``most_rounds`` are an error.
    """
    rows = batch
    for k in keys:
        rows = rows.join(target.select(k), k, "left_anti")
    rows, added = cut(rows.withColumn("_place", F.struct(*order))), None
    for _ in range(most_rounds):
        firsts = rows.withColumns({f"_first{i}": F.when(F.col(k).isNull(), F.col("_place")).otherwise(F.min("_place").over(W.partitionBy(k))) for i, k in enumerate(keys)})
        new = cut(firsts.where(" and ".join(f"_place = _first{i}" for i in range(len(keys)))).drop(*[f"_first{i}" for i in range(len(keys))]))
        added = new if added is None else added.unionByName(new)
        left = rows
        for k in keys:
            left = left.join(new.select(k), k, "left_anti")
        old, rows = rows, cut(left)
        release(old)
        if not rows.take(1):
            return added.drop("_place")
    raise ValueError(f"keys depend on each other in more than {most_rounds} steps")


def insert_strict(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the batch, or an error if it holds one of its keys: a page that was committed before isn't committed again."""
    held = batch.join(target.select(*keys).withColumn("_held", F.lit(True)), keys, "left")
    checked = held.where(F.assert_true(F.col("_held").isNull(), F.lit("a row with this key is there already")).isNull()).drop("_held")
    return target.unionByName(checked)


def looked_up(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a list of ids; ids that are not there are left out."""
    return df.join(ids.select(key), key, "left_semi")


def keyset_page(df: DataFrame, key: str, after: object, limit: int) -> DataFrame:
    """The page of a scroll that follows the last key seen, None for the first: a filter that reaches the scan, and a top of ``limit`` rows."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def shuffled(df: DataFrame, key: str, seed: int) -> list[Column]:
    """An order that a seed fixes and that no other column follows: by the digest of seed and key, ties by the key."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)]


def probe(df: DataFrame, key: str, seed: int, n: int = 200) -> DataFrame:
    """A sample of n rows without replacement that a seed fixes."""
    return df.orderBy(*shuffled(df, key, seed)).limit(n)


def missing_page(page_rows: DataFrame, index: DataFrame, staged: DataFrame, key: str, order: list[Column], target: int, done: int) -> DataFrame:
    """Rows of a page that neither the index nor the staged rows hold, as many as the target still lacks."""
    held = index.select(key).unionByName(staged.select(key))
    return page_rows.join(held, key, "left_anti").orderBy(*order).limit(max(target - done, 0))


def grouped_in_order(df: DataFrame, key: str, place: Column, row: str) -> DataFrame:
    """(key, group, rows, first): groups of a key in order of their first row; a row without a key is a group of its own, named after ``row``. ``group`` counts from 1."""
    named = df.select(F.col(key), F.coalesce(F.concat(F.lit("k"), F.col(key)), F.concat(F.lit("r"), F.col(row).cast("string"))).alias("_g"), place.alias("_at"))
    groups = named.groupBy("_g", key).agg(F.count("*").alias("rows"), F.min("_at").alias("first"))
    return numbered(groups, ["first", "_g"], "group").select(key, (F.col("group") + 1).alias("group"), "rows", "first")


def upsert(target: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The table after INSERT OR REPLACE of the batch, of which the last row of each key counts."""
    last = first_per(batch, [key], order)
    return target.join(last.select(key), key, "left_anti").unionByName(last)


def merge_payload(target: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """The table with the update's columns where it has a value; other columns and rows stay."""
    names = [c for c in update.columns if c != key]
    both = target.join(update.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    old = [F.coalesce(f"_{c}", c).alias(c) if c in target.columns else F.col(f"_{c}").alias(c) for c in names]
    return both.select(key, *[c for c in target.columns if c != key and c not in names], *old)


def first_place_last_value(df: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """One row per key: the place where it came first, the value it had last."""
    return df.groupBy(key).agg(F.min(place).alias(place), F.max_by(value, place).alias(value))


def numbered(df: DataFrame, order: list[str], to: str = "n") -> DataFrame:
    """A global row number from 0 without sorting all rows in one task.

    Rows are range-partitioned by the order and sorted within partitions; counts of the partitions, one small row each, give every partition its start.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))  # written, as range borders are sampled anew whenever they are computed
    own = parts.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    starts = parts.groupBy("_p").count().withColumn("_s", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(starts.select("_p", "_s")), "_p").withColumn(to, F.col("_i") + F.col("_s") - 1).drop("_p", "_i", "_s")


def stride(df: DataFrame, order: list[str], workers: int) -> DataFrame:
    """Worker of each row when rows are dealt in turn."""
    return numbered(df, order).withColumn("worker", (F.col("n") % workers).cast("int"))


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Chunk of each row when rows are cut in order."""
    return numbered(df, order).withColumn("chunk", F.floor(F.col("n") / size).cast("long"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int, most: int = 100) -> DataFrame:
    """Rows of a page, each with has_more: whether a row follows the page. One row more than the page is fetched, ``most`` at most."""
    fetched = min(limit + 1, most)
    rows = df.orderBy(*order).offset(offset).limit(fetched).withColumn("_r", F.row_number().over(W.orderBy(*order)))
    more = rows.agg((F.count("*") > limit).alias("has_more"))
    return rows.where(F.col("_r") <= limit).drop("_r").crossJoin(F.broadcast(more))


def same_count(copy: DataFrame, source: DataFrame) -> DataFrame:
    """One row: the counts of both, or an error if the copy holds less."""
    both = copy.agg(F.count("*").alias("copied")).crossJoin(source.agg(F.count("*").alias("held")))
    return both.where(F.assert_true(F.col("copied") >= F.col("held"), F.lit("the copy holds less than its source")).isNull())
