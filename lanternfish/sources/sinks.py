"""Sinks: tar shards, manifests, reports, matrices, and commits that a repeat leaves unchanged."""

from __future__ import annotations

import io
import itertools
import json
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _members(rows: Iterator[tuple[str, bytes | None, str | None]]) -> Iterator[tuple[tarfile.TarInfo, bytes]]:
    """Image and metadata of each row as members of an archive."""
    for key, image, text in rows:
        for suffix, body in ((".webp", bytes(image or b"")), (".json", (text or "").encode())):
            head = tarfile.TarInfo(f"{key}{suffix}")
            head.size = len(body)
            yield head, body


def write_tar_shards(df: DataFrame, folder: str, shards: int, point_id: str = "point_id", data: str = "data", meta: str = "meta") -> DataFrame:
    """Writes each shard's rows to one archive shard-<number>-<checksum of its ids>.tar; gives (shard, name, members). ``folder`` has to be one that all executors share.

    A shard is streamed to a file of the attempt's own and renamed when complete, and its name follows from its content: a task that is run again replaces it by itself.
    """
    columns = [F.pmod(F.xxhash64(point_id), F.lit(shards)).cast("int").alias("shard"), point_id, data, meta]
    rows = df.select(*columns).repartition(shards, "shard").sortWithinPartitions("shard", point_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        for shard, group in itertools.groupby(stream, key=lambda row: row[0]):
            part, ids, count = Path(folder) / f".{shard}-{uuid.uuid4().hex}.part", 0, 0

            def kept() -> Iterator[tuple[str, bytes | None, str | None]]:
                nonlocal ids, count
                for _, key, image, text in group:  # noqa: B023 - consumed before the next group
                    ids, count = zlib.crc32(key.encode() + b"\n", ids), count + 1
                    yield key, image, text

            with tarfile.open(part, "w|") as tar:
                for head, body in _members(kept()):
                    tar.addfile(head, io.BytesIO(body))
            name = f"shard-{shard:05d}-{ids:08x}.tar"
            part.replace(Path(folder) / name)
            yield pd.DataFrame([(shard, name, count)], columns=["shard", "name", "members"])

    Path(folder).mkdir(parents=True, exist_ok=True)
    return rows.mapInPandas(run, "shard int, name string, members long")


def stored(df: DataFrame, folder: str, order: str, name: str, data: str) -> DataFrame:
    """Writes each row's data to a file of the shared folder; gives (order, place): where it lies, '' where writing failed, so a batch keeps its order and one failure costs one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = []
            for key, body in zip(batch[name], batch[data], strict=True):
                try:
                    target = Path(folder) / key
                    target.parent.mkdir(parents=True, exist_ok=True)
                    part = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
                    part.write_bytes(bytes(body))
                    part.replace(target)
                    places.append(str(target))
                except (OSError, TypeError, ValueError):
                    places.append("")
            yield pd.DataFrame({order: batch[order], "place": places})

    return df.select(order, name, data).mapInPandas(run, f"`{order}` {dict(df.dtypes)[order]}, place string")


def freeze_prompts(prompts: DataFrame, path: str, groups: list[str], scale: float, bias: float) -> None:
    """The prompts (group, text, prompt_vec) with their places, group after group in the given order, and the scale and bias of their scores, as one small table."""
    rank = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("group"))
    placed = prompts.where(rank > 0).withColumn("place", (F.row_number().over(W.orderBy(rank, "text")) - 1).cast("int"))
    placed.withColumns({"scale": F.lit(float(scale)), "bias": F.lit(float(bias))}).coalesce(1).write.mode("overwrite").parquet(path)


def state_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The state that was saved at a path; None if there is none. A state that is there and can't be read is an error, not an empty state."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.parquet(path)
    rows.take(1)
    return rows


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at a path, made empty if it isn't there; one that is stays as it is."""
    held = state_at(spark, path)
    if held is None:
        spark.createDataFrame([], schema).coalesce(1).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_manifest(df: DataFrame, path: str, by: str = "shard") -> None:
    """NDJSON, a folder for each shard."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_matrix(df: DataFrame, path: str, key: str = "id") -> None:
    """Vectors in order of their ids, as one range-partitioned table."""
    df.orderBy(key).write.mode("overwrite").parquet(path)


def script_safe(x: str) -> str:
    """JSON that can stand in a page's script."""
    return x.replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def write_report(df: DataFrame, path: str) -> int:
    """A result as one JSON file, replaced as a whole. Rows pass through the driver one partition at a time, so a report may have any number of them."""
    part, n = Path(f"{path}.part"), 0
    with part.open("w", encoding="utf-8") as out:
        out.write("[")
        for row in df.toLocalIterator(prefetchPartitions=True):
            out.write(("," if n else "") + script_safe(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False)))
            n += 1
        out.write("]")
    part.replace(path)
    return n


def signature_guard(path: str, signature: dict) -> None:
    """Refuses to resume with other inputs than those the state began with."""
    p, own = Path(path), json.dumps(signature, sort_keys=True)
    if p.exists() and p.read_text() != own:
        raise ValueError("the inputs differ from those the state began with")
    p.write_text(own)
