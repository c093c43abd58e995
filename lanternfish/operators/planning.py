"""Planning of discovery work: ranges, units, weights and balanced assignment."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternfish.operators.relational import numbered


def name_ranges(spark: SparkSession) -> DataFrame:
    """(lower, upper): half-open ranges of names that cover all: from '', each digit, capital and capital with a small letter; the last has no end."""
    letter = lambda first, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.char(i + first))
    big, small = letter(65, 26), letter(97, 26)
    pairs = F.flatten(F.transform(big, lambda a: F.transform(small, lambda b: F.concat(a, b))))
    starts = spark.range(1).select(F.explode(F.array_sort(F.array_distinct(F.concat(F.array(F.lit("")), letter(48, 10), big, pairs)))).alias("lower"))
    return starts.withColumn("upper", F.lead("lower").over(W.orderBy("lower")))


def famous(people: DataFrame, links: str, least: int, kinds: DataFrame, kind: str, gone: DataFrame | None, key: str, top: int) -> DataFrame:
    """People of the wanted kinds with at least so many links, the most linked first, ``top`` of them; with ``gone``, those in it are left out."""
    rows = people.where(F.col(links) >= least).join(kinds.select(kind), kind, "left_semi")
    if gone is not None:
        rows = rows.join(gone.select(key), key, "left_anti")
    return rows.orderBy(F.desc(links), key).limit(top)


def page_ranks(pages: DataFrame, page: str, items: str, per_page: int) -> DataFrame:
    """(item, rank): items of pages, which count from 1, with their rank in the whole list, from 0."""
    rows = pages.select(page, F.posexplode(items).alias("_i", "item"))
    return rows.select("item", ((F.col(page) - 1) * per_page + F.col("_i")).alias("rank"))


def next_unit(units: DataFrame, page: str, row: str) -> DataFrame:
    """The unit that is walked next, breadth first: the lowest page, and of these the first row."""
    return units.orderBy(page, row).limit(1)


def rotation(visits: DataFrame, page: str, job: str, cursor: str, place: str) -> DataFrame:
    """Visits of a round-robin queue in their order, ``turn`` from 0: all first pages by job, all second ones, and so on. ``stuck`` marks a visit that brought the cursor of the visit before: an error of its job."""
    before = F.lag(cursor).over(W.partitionBy(job).orderBy(page))
    return numbered(visits.withColumn("stuck", F.coalesce(F.col(cursor) == before, F.lit(False))), [page, place, job], "turn")


def page_units(df: DataFrame, total: str, per_page: int = 100, most: int = 30) -> DataFrame:
    """One row (…, page) per page of results, as many as the source pages to."""
    pages = F.least(F.lit(most), F.ceil(F.col(total) / per_page)).cast("int")
    return df.where(pages >= 1).withColumn("page", F.explode(F.sequence(F.lit(1), pages)))


def weighted_units(topics: DataFrame, hits: DataFrame, licences: DataFrame, bands: DataFrame, cap: float = 10_000.0) -> DataFrame:
    """(topic, lic, band, weight): all units, each with the rows it may yield: the topic's hits over its units, capped, 1 if none."""
    per_topic = licences.crossJoin(bands)
    n = per_topic.agg(F.count("*").alias("n"))
    weight = F.least(F.lit(cap), F.greatest(F.coalesce("hits", F.lit(0)), F.lit(0)) / F.col("n"))
    units = topics.join(hits, "topic", "left").crossJoin(F.broadcast(per_topic)).crossJoin(F.broadcast(n))
    return units.select("topic", "lic", "band", F.when(weight == 0, 1.0).otherwise(weight).alias("weight"))


def balanced(units: DataFrame, order: list[str], weight: str, lanes: int) -> DataFrame:
    """Every unit with ``lane``: longest first, each to the least loaded lane, ties to the lower.

    The rule is sequential: each placement needs the one before. So all units pass, sorted on disk if need be, through one iterator that holds the loads of the lanes alone, however many units there are.
    """
    columns = units.columns
    rows = units.repartition(1).sortWithinPartitions(F.desc(weight), *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap = [(0.0, i) for i in range(lanes)]
        for batch in batches:
            lane = []
            for w in batch[weight]:
                load, i = heapq.heappop(heap)
                lane.append(i)
                heapq.heappush(heap, (load + w, i))
            yield batch[columns].assign(lane=lane)

    return rows.mapInPandas(run, ", ".join([*[f"`{n}` {t}" for n, t in units.dtypes], "lane int"]))
