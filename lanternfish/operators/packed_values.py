"""Problem 2: several values packed in one field, one row per value with its place.

A field is cut at separators outside quotes. Some legitimate values hold a separator and are sometimes typed without quotes. The dictionary of such
whole values is learned from the collection itself: values that are quoted somewhere, and of which at least one part hardly ever stands
alone. An automaton finds all of them in a field in one pass, and dynamic programming picks the cover of the field by known values
and single pieces that leaves the fewest pieces; separators inside a chosen known value are protected.

Rules: separators are comma, semicolon, bar, tab, line end, bullet, the ideographic and full-width ones, a slash or middle dot with blanks on
both sides, and # in a field that begins with #. Quotes are "…", “…” and '…' around a whole piece; "" and \\" inside "…" stand for one quote.
Brackets or braces around the whole field and a leading # are dropped, as are empty pieces; equal values all count.

Defined cases: null, empty and blank fields give no rows; a quote that is never closed is an ordinary character; an id counts once (of several
different fields, the least); null ids are left out; fields of any length are cut whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.session import cut

SEPARATOR = r"(?:[,;|\t\r\n•、，；｜]|(?<=\s)[/·](?=\s))"
END = rf"(?=\s*(?:{SEPARATOR}|$))"
PIECE = re.compile(
    rf"""\s*(?:"(?P<double>(?:[^"\\]|""|\\.)*)"{END}|“(?P<curly>[^“”]*)”{END}|'(?P<single>(?:[^']|'(?!\s*(?:{SEPARATOR}|$)))+)'{END}|(?P<plain>.*?)(?={SEPARATOR}|$))\s*?(?P<sep>{SEPARATOR}|$)""",
    re.DOTALL,
)
HASHED = re.compile(rf"(?:^|{SEPARATOR}|\s)?\s*#")
ESCAPE = re.compile(r'""|\\(?:u([0-9a-fA-F]{4})|(.))', re.DOTALL)
CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
VALUES = T.StructType([T.StructField("id", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("quoted", T.BooleanType())])

SPANS = T.StructType([T.StructField("id", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])


def _unescape(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else CONTROL.get(m[2], m[2]) if m[2] else '"'


def _inner(field: str) -> str:
    """The field without the brackets or braces around the whole of it."""
    field = field.strip()
    for a, b in ("[]", "{}"):
        if len(field) > 1 and field[0] == a and field[-1] == b:
            plain = re.sub(r'"(?:[^"\\]|""|\\.)*"', "", field[1:-1])
            if a not in plain and b not in plain:
                return field[1:-1]
    return field


def pieces(field: str) -> list[tuple[str, bool, int, int]]:
    """(value, quoted, start, end) of each non-empty piece of a field; start and end are places in ``_inner(field)``."""
    inner, out, at = _inner(field), [], 0
    if inner.lstrip().startswith("#"):
        marks = [m.span() for m in HASHED.finditer(inner)]
        for (_, start), (end, _) in zip(marks, [*marks[1:], (len(inner), 0)], strict=True):
            out += [(v.removeprefix("#").strip(), q, start + s, start + e) for v, q, s, e in _cut(inner[start:end])]
        return [p for p in out if p[0]]
    for v, q, s, e in _cut(inner):
        value = v if q else v.removeprefix("#").strip()
        if value:
            out.append((value, q, at + s, at + e))
    return out


def _cut(text: str) -> list[tuple[str, bool, int, int]]:
    out, at = [], 0
    while at <= len(text):
        m = PIECE.match(text, at)
        kind = next(k for k in ("double", "curly", "single", "plain") if m[k] is not None)
        value = m[kind]
        if kind == "double" and ('""' in value or "\\" in value):
            value = ESCAPE.sub(_unescape, value)
        value = value.strip()
        if value:
            out.append((value, kind != "plain", *m.span(kind)))
        if m.end() == at and not m["sep"]:
            break
        at = m.end() if m["sep"] else len(text) + 1
    return out


def spans(field: str, known: object) -> list[tuple[int, int]]:
    """(i, j): the pieces i to j of the field are unquoted and together a value of the automaton ``known``."""
    cuts = pieces(field)
    if known is None or len(cuts) < 2:
        return []
    starts, ends = {p[2]: i for i, p in enumerate(cuts) if not p[1]}, {p[3]: i for i, p in enumerate(cuts) if not p[1]}
    found = []
    for end, length in known.iter(_inner(field)):
        i, j = starts.get(end + 1 - length), ends.get(end + 1)
        if i is not None and j is not None and j > i and not any(p[1] for p in cuts[i : j + 1]):
            found.append((i, j))
    return found


def cover(field: str, whole: list[tuple[int, int]]) -> list[tuple[str, bool, int, int]]:
    """The pieces of a field, neighbouring ones joined where a span of ``whole`` says that together they are one value.

    best[i] is the fewest pieces that cover the first i pieces; ties keep the longer last value.
    """
    cuts = pieces(field)
    if not whole:
        return cuts
    joined: dict[int, list[int]] = {}
    for i, j in whole:
        joined.setdefault(j, []).append(i)
    inner, best, step = _inner(field), [0], [0]
    for j in range(len(cuts)):
        options = [(best[i] + 1, i) for i in [*joined.get(j, []), j]]
        cost, i = min(options)
        best.append(cost)
        step.append(i)
    out, j = [], len(cuts)
    while j:
        i = step[j]
        out.append(cuts[i] if j - i == 1 else (inner[cuts[i][2] : cuts[j - 1][3]], False, cuts[i][2], cuts[j - 1][3]))
        j = i
    return out[::-1]


@lru_cache(maxsize=4)
def _automaton(name: str, values: Shared) -> object:
    """The automaton of a broadcast dictionary, built once by each worker; ``name`` tells dictionaries apart."""
    import ahocorasick

    known = ahocorasick.Automaton()
    for value in values.broadcast.value:
        known.add_word(value, len(value))
    known.make_automaton()
    return known


class Shared:
    """A broadcast that is equal to any other, so that the name alone is the key of what is kept."""

    def __init__(self, broadcast: Broadcast) -> None:
        self.broadcast = broadcast

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Shared)

    def __hash__(self) -> int:
        return 0


def _columns(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "integer": pa.int32(), "boolean": pa.bool_()}
    cols = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(cols, schema, strict=True)], names=schema.names)


def _split(fields: DataFrame, dictionary: list[str] | None = None) -> DataFrame:
    """(id, pos, tag, quoted) of the fields (id, field), or (id, field, whole) with spans that are known, or by a dictionary."""
    name = uuid.uuid4().hex
    values = Shared(fields.sparkSession.sparkContext.broadcast(dictionary)) if dictionary else None
    listed = "whole" in fields.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = _automaton(name, values) if values else None
            given = batch.column(2).to_pylist() if listed else [None] * batch.num_rows
            rows = []
            for i, field, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), given, strict=True):
                at = [(w["i"], w["j"]) for w in whole or ()] if listed else spans(field, known) if known else []
                rows += [(i, p + 1, v[0], v[1]) for p, v in enumerate(cover(field, at))]
            yield _columns(rows, VALUES)

    return fields.mapInArrow(run, VALUES)


def _spans(fields: DataFrame, dictionary: list[str]) -> DataFrame:
    """(id, i, j): the spans of each field that are values of the dictionary."""
    name, values = uuid.uuid4().hex, Shared(fields.sparkSession.sparkContext.broadcast(dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = _automaton(name, values)
            yield _columns([(i, *at) for i, field in zip(*(c.to_pylist() for c in batch.columns), strict=True) for at in spans(field, known)], SPANS)

    return fields.select("id", "field").mapInArrow(run, SPANS)


def whole_values(values: DataFrame) -> DataFrame:
    """(tag): whole values that hold a separator: quoted somewhere, with a part that stands alone at most a fourth as often as the whole is quoted. The rule is relative, so it is the same at any size."""
    counted = values.groupBy("tag", "quoted").count()
    holding = counted.where("quoted").where(F.col("tag").rlike(SEPARATOR)).select("tag", "count")
    parts = holding.select("tag", "count", F.explode(F.split("tag", SEPARATOR)).alias("part")).withColumn("part", F.trim("part"))
    alone = counted.where(~F.col("tag").rlike(SEPARATOR)).groupBy(F.col("tag").alias("part")).agg(F.sum("count").alias("alone"))
    seen = parts.join(alone, "part", "left").groupBy("tag").agg(F.max("count").alias("n"), F.min(F.coalesce("alone", F.lit(0))).alias("alone"))
    return seen.where(F.col("alone") * 4 <= F.col("n")).select("tag")


def unpacked(df: DataFrame, key: str = "id", column: str = "tags", letters: int = 4_000_000) -> DataFrame:
    """(id, pos, tag): every value of every field, with its place from 1.

    A dictionary of more than about ``letters`` letters is not sent at once: its parts search the fields one after the other, the spans they find are joined to the fields, and
    the cover is chosen from all of them, so every whole value counts, however many there are.
    """
    fields = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(F.min(column).alias("field"))
    fields = cut(fields.where(F.col("field").rlike(r"\S")))
    known = cut(whole_values(cut(_split(fields))))
    parts = max(1, -(-(known.agg(F.sum(F.length("tag"))).first()[0] or 0) // letters))
    chunk = lambda p: sorted(x.tag for x in known.where(F.pmod(F.xxhash64("tag"), F.lit(parts)) == p).collect())  # noqa: E731 - about ``letters`` letters
    if parts == 1:
        return _split(fields, chunk(0)).drop("quoted")
    found = None
    for p in range(parts):
        part = cut(_spans(fields, chunk(p)))
        found = part if found is None else found.unionByName(part)
    listed = found.groupBy("id").agg(F.collect_list(F.struct("i", "j")).alias("whole"))
    return _split(fields.join(listed, "id", "left").select("id", "field", "whole")).drop("quoted")


def unpacked_several(df: DataFrame, key: str = "id", column: str = "tags") -> DataFrame:
    """(id, pos, tag) of the fields that hold at least two values."""
    values = cut(unpacked(df, key, column))
    several = values.where("pos = 2").select("id")
    return values.join(several, "id", "left_semi")
