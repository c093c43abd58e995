"""File sources: text lists, JSON maps, NDJSON manifests, raw vectors and tar shards."""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.schema import MANIFEST


def text_list(spark: SparkSession, path: str, strip_first: bool = True) -> DataFrame:
    """(value): lines of a list, stripped, without blank lines and comments. A comment begins with #, after stripping or, without ``strip_first``, in the line as it is."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("value").alias("raw"))
    return lines.where((F.col("value") != "") & ~F.col("value" if strip_first else "raw").startswith("#")).select("value")


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that holds one JSON object of whole numbers."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,bigint>")))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a JSON list whose items are strings or objects with a name."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    return items.select(F.coalesce(F.get_json_object("item", "$.name"), F.col("item")).alias("name"))


def manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """Rows of NDJSON manifests under a path; blank lines are no rows, and no schema is inferred."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").json(path)


def vector_of_bytes(raw: Column, size: int) -> Column:
    """Little-endian 32-bit floats to an array."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decode(x: pd.Series) -> pd.Series:
        import numpy as np

        return x.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) == 4 * size else None)

    return decode(raw)


def inside(name: Column) -> Column:
    """Whether a member's name stays in its folder: relative, and not above it at any point."""
    steps = F.filter(F.split(name, "/"), lambda s: (s != "") & (s != "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["least"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("least")))
    return ~name.startswith("/") & (depth["least"] >= 0) & (F.size(steps) > 0)


MEMBERS = T.StructType([T.StructField("shard", T.StringType()), T.StructField("name", T.StringType()), T.StructField("regular", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType())])


def tar_members(spark: SparkSession, path: str, suffix: str = "", unsafe: bool = False, strict: bool = False) -> DataFrame:
    """(shard, name, regular, size, data) of the members of the tar shards under a path, one shard in memory at a time.

    Links, devices and names that leave the folder are never followed: they are an error if ``strict``, rows without data if ``unsafe``, and else left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        good = m.isreg() and not m.name.startswith("/") and not posixpath.normpath(m.name).startswith("..")
                        if strict and not good:
                            raise ValueError(f"unsafe member {m.name!r} in {posixpath.basename(where)}")
                        if (good or unsafe) and m.name.endswith(suffix):
                            rows.append((posixpath.basename(where), m.name, m.isreg(), m.size, tar.extractfile(m).read() if m.isreg() else None))
                yield pd.DataFrame(rows, columns=MEMBERS.names)

    return files.mapInPandas(run, MEMBERS)


def matched_members(rows: DataFrame, members: DataFrame, point_id: str = "point_id") -> DataFrame:
    """Rows with the member that is named after their point; rows without one are kept with a null, so what is missing can be reported."""
    by = members.withColumn(point_id, F.regexp_replace("name", r"^.*/|\.[^.]*$", ""))
    return rows.join(by.select(point_id, "data"), point_id, "left")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(object_key, data) of single objects under a path; the key is the path below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.regexp_extract(F.col("path"), "^.*?" + path.rstrip("/").replace(".", "[.]") + "/(.*)$", 1)
    return files.select(below.alias("object_key"), F.col("content").alias("data"))


def fetched(rows: DataFrame, members: DataFrame, singles: DataFrame, point_id: str = "point_id") -> DataFrame:
    """Rows (…, shard, object_key) with their data: of their shard's member, or, for a row without a shard, of the object of its own; null where neither is there."""
    packed = matched_members(rows.where(F.col("shard").isNotNull()), members, point_id)
    single = rows.where(F.col("shard").isNull()).join(singles, "object_key", "left").select(*packed.columns)
    return packed.unionByName(single)


def pulled(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> tuple[DataFrame, DataFrame]:
    """All shards of a remote folder: manifest rows of meta/ (of several rows of an image, that of the first file), and members of thumbs/, those that leave the folder being an error."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(f"{path}/meta").select("*", F.col("_metadata.file_path").alias("_file")).where("image_id is not null")
    first = rows.groupBy("image_id").agg(F.min_by(F.struct(*[f.name for f in schema.fields]), F.struct("_file", *[f.name for f in schema.fields])).alias("r"))
    return first.select("r.*"), tar_members(spark, f"{path}/thumbs", strict=True)


def prompt_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, float, float]:
    """The frozen prompts (group, place, text, prompt_vec) with the scale and bias of their scores; places of a group are in a row."""
    rows = spark.read.parquet(path)
    scale, bias = rows.select("scale", "bias").first()
    return rows.drop("scale", "bias"), scale, bias
