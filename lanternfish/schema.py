"""Schemas of the canonical rows. 0 and '' mean unknown; a null score means not scored."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "v": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


IMAGE = _struct("image_id:s title:s creator:s license:s license_class:s license_url:s source_url:s full_url:s thumb_origin:s width:i height:i mime:s sha1:s description:s tags:s")
JOB = _struct("id:l build:s unit_hash:s unit:s cursor:s state:s worker:s lease_until:d attempts:i produced:i reason:s created_at:d updated_at:d")
VECTOR = _struct("id:s vec:v")
MANIFEST = T.StructType([*IMAGE.fields, *_struct("cdn:s shard:s").fields])
EVENT = _struct("job:l at:d seq:l kind:s worker:l amount:d cursor:s")
EMPTY_TEXT = {f.name: "" for f in IMAGE.fields if isinstance(f.dataType, T.StringType)}
EMPTY_NUMBER = {f.name: 0 for f in IMAGE.fields if isinstance(f.dataType, T.IntegerType)}
