from __future__ import annotations

import io
import json
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import jobqueue
from lanternfish.schema import EVENT
from lanternfish.sources import catalogue, files, sinks
from lanternfish.streaming import streams


def test_lists_and_maps(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" a \n\n# no\nb\n")
    assert [r.value for r in files.text_list(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]
    (tmp_path / "late.txt").write_text("a\n  # kept\n# no\n")
    assert [r.value for r in files.text_list(spark, str(tmp_path / "late.txt"), strip_first=False).collect()] == ["a", "# kept"]
    (tmp_path / "m.json").write_text('{"x": 3,\n "y": 4}')
    assert dict(map(tuple, files.json_map(spark, str(tmp_path / "m.json")).collect())) == {"x": 3, "y": 4}
    (tmp_path / "n.json").write_text('["Ann", {"name": "Bob"}]')
    assert [r.name for r in files.names(spark, str(tmp_path / "n.json")).collect()] == ["Ann", "Bob"]


def test_manifest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.jsonl").write_text('{"image_id": "x:1", "cdn": "k"}\n\n')
    (tmp_path / "a" / "1.txt").write_text("no")
    rows = files.manifest(spark, str(tmp_path)).where("image_id is not null").collect()
    assert [(r.image_id, r.cdn, r.title) for r in rows] == [("x:1", "k", None)]


def test_vector_bytes(spark):
    df = spark.createDataFrame([(bytearray(struct.pack("<2f", 1.0, -2.0)),), (bytearray(b"bad"),), (None,)], "b binary")
    assert [r.v for r in df.select(files.vector_of_bytes(F.col("b"), 2).alias("v")).collect()] == [[1.0, -2.0], None, None]


def test_adversarial_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name in ("ok.webp", "../x.webp", "/abs/x.webp", "a/../../x.webp"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"hi"))
        for kind, name in ((tarfile.SYMTYPE, "s.webp"), (tarfile.LNKTYPE, "h.webp")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, "ok.webp"
            tar.addfile(info)
    assert [(r.name, bytes(r.data)) for r in files.tar_members(spark, str(tmp_path), ".webp").collect()] == [("ok.webp", b"hi")]
    with pytest.raises(Exception, match="unsafe member"):
        files.tar_members(spark, str(tmp_path), strict=True).collect()
    every = files.tar_members(spark, str(tmp_path), ".webp", unsafe=True)
    assert [r.name for r in every.where(files.inside(F.col("name")) & F.col("regular")).collect()] == ["ok.webp"]


def test_tar_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}", bytearray(f"d{i}".encode()), "{}") for i in range(20)], "point_id string, data binary, meta string")
    written = sinks.write_tar_shards(rows, str(tmp_path), 3).collect()
    again = sinks.write_tar_shards(rows, str(tmp_path), 3).collect()
    assert sorted(written) == sorted(again) and sum(r.members for r in written) == 20
    back = files.matched_members(rows.select("point_id"), files.tar_members(spark, str(tmp_path), ".webp"))
    assert {r.point_id: bytes(r.data) for r in back.collect()} == {f"p{i}": f"d{i}".encode() for i in range(20)}


def test_catalogue_pages_and_pushed_filter(spark, tmp_path):
    for source, n in (("met", 2), ("nasa", 1)):
        (tmp_path / source).mkdir()
        for page in range(n):
            (tmp_path / source / f"{page}.json").write_text(json.dumps({"results": [{"id": f"{source}{page}{i}"} for i in range(2)]}))
    catalogue.register(spark)
    df = spark.read.format("catalogue").option("path", str(tmp_path)).load()
    assert df.count() == 6
    met = df.where("source = 'met'")
    assert met.count() == 4 and met.rdd.getNumPartitions() == 2


def test_catalogue_ranges_and_continuation(spark, tmp_path):
    (tmp_path / "met").mkdir()
    for page in range(12):
        body = {"results": [{"id": f"{page}-{i}", "license": "cc0" if i else "by", "width": 100 * page} for i in range(3)], "continue": {"page": page + 1}} if page < 10 else {"results": None}
        (tmp_path / "met" / f"{page}.json").write_text(json.dumps(body))
    catalogue.register(spark)
    df = spark.read.format("catalogue").option("path", str(tmp_path)).load()
    some = df.where("page >= 3 and page < 9 and source in ('met', 'nasa')")
    assert some.rdd.getNumPartitions() == 6 and some.count() == 18 and df.where("page >= 10").count() == 0
    assert df.where("page = 4").first().continuation == '{"page": 5}'
    large = spark.read.format("catalogue").option("path", str(tmp_path)).option("licence", "cc0").option("least_width", "500").load()
    assert large.count() == 10


def test_rows_without_a_shard_come_from_single_objects(spark, tmp_path):
    packed = spark.createDataFrame([("p1", bytearray(b"one"), "{}")], "point_id string, data binary, meta string")
    sinks.write_tar_shards(packed, str(tmp_path / "tars"), 1).collect()
    (tmp_path / "obj" / "t").mkdir(parents=True)
    (tmp_path / "obj" / "t" / "p2.webp").write_bytes(b"two")
    rows = spark.createDataFrame([("p1", "s0", "t/p1.webp"), ("p2", None, "t/p2.webp"), ("p3", None, "t/p3.webp")], "point_id string, shard string, object_key string")
    got = files.fetched(rows, files.tar_members(spark, str(tmp_path / "tars"), ".webp"), files.objects(spark, str(tmp_path / "obj")))
    assert {r.point_id: r.data and bytes(r.data) for r in got.collect()} == {"p1": b"one", "p2": b"two", "p3": None}


def test_pull_merges_shards(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "a.jsonl").write_text('{"image_id": "x:1", "title": "first"}\n\n{"image_id": "x:2"}\n')
    (tmp_path / "meta" / "b.jsonl").write_text('{"image_id": "x:1", "title": "second"}\n')
    sinks.write_tar_shards(spark.createDataFrame([("x:1", bytearray(b"1"), "")], "point_id string, data binary, meta string"), str(tmp_path / "thumbs"), 1).collect()
    rows, members = files.pulled(spark, str(tmp_path))
    assert {r.image_id: r.title for r in rows.collect()} == {"x:1": "first", "x:2": None} and members.count() == 2


def test_stores_keep_order_and_failures(spark, tmp_path):
    (tmp_path / "file").write_text("")
    rows = spark.createDataFrame([(0, "a.bin", bytearray(b"a")), (1, "file/x.bin", bytearray(b"b")), (2, "c/d.bin", bytearray(b"c")), (3, "e.bin", None)], "n int, name string, data binary")
    got = [r.place for r in sinks.stored(rows, str(tmp_path), "n", "name", "data").orderBy("n").collect()]
    assert got == [str(tmp_path / "a.bin"), "", str(tmp_path / "c" / "d.bin"), ""] and (tmp_path / "c" / "d.bin").read_bytes() == b"c"


def test_prompts_are_frozen_and_loaded(spark, tmp_path):
    prompts = spark.createDataFrame([("safe", "b", [0.0, 1.0]), ("unsafe", "z", [1.0, 0.0]), ("safe", "a", [0.5, 0.5]), ("other", "q", [1.0, 1.0])], "group string, text string, prompt_vec array<double>")
    sinks.freeze_prompts(prompts, str(tmp_path / "p"), ["unsafe", "safe"], 117.3, -12.93)
    rows, scale, bias = files.prompt_matrix(spark, str(tmp_path / "p"))
    assert (scale, bias) == (117.3, -12.93) and [(r.group, r.text) for r in rows.orderBy("place").collect()] == [("unsafe", "z"), ("safe", "a"), ("safe", "b")]


def test_absent_state_is_not_failed_state(spark, tmp_path):
    assert sinks.state_at(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader says
        sinks.state_at(spark, str(tmp_path / "bad"))
    made = sinks.ensure_table(spark, str(tmp_path / "t"), EVENT)
    spark.createDataFrame([(1, 0.0, 1, "seed", 0, 0.0, None)], EVENT).write.mode("append").parquet(str(tmp_path / "t"))
    assert made.count() == 0 and sinks.ensure_table(spark, str(tmp_path / "t"), EVENT).count() == 1


def test_history_is_appended_once(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        streams.run(streams.history(streams.stream(spark, str(tmp_path / "in"), spark.range(1).schema, 100), str(tmp_path / "h"), str(tmp_path / "cp")))
    assert spark.read.json(str(tmp_path / "h")).count() == 6


def test_reports_and_guards(spark, tmp_path):
    n = sinks.write_report(spark.createDataFrame([("<a> ",)], "x string"), str(tmp_path / "r.json"))
    text = (tmp_path / "r.json").read_text()
    assert n == 1 and "<" not in text and json.loads(text) == [{"x": "<a> "}]
    assert sinks.write_report(spark.range(30_000), str(tmp_path / "r.json")) == 30_000 and len(json.loads((tmp_path / "r.json").read_text())) == 30_000
    sinks.signature_guard(str(tmp_path / "sig"), {"a": 1})
    sinks.signature_guard(str(tmp_path / "sig"), {"a": 1})
    with pytest.raises(ValueError, match="differ"):
        sinks.signature_guard(str(tmp_path / "sig"), {"a": 2})


def test_commits_are_exactly_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(src)
    schema = spark.range(1).schema
    for _ in range(2):
        streams.run(streams.committed(streams.stream(spark, src, schema), out, str(tmp_path / "cp")))
    assert spark.read.parquet(out).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    streams.run(streams.committed(streams.stream(spark, src, schema), out, str(tmp_path / "cp")))
    assert spark.read.parquet(out).select("id").distinct().count() == spark.read.parquet(out).count() == 15


def test_rate_stream(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 4 != 0).alias("ok"))
    rows.write.parquet(str(tmp_path / "in"))
    out = streams.rate_stream(streams.stream(spark, str(tmp_path / "in"), rows.schema, 100), "ts", F.col("ok"))
    streams.run(streams.committed(out, str(tmp_path / "out"), str(tmp_path / "cp")).outputMode("update"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("ok"), F.sum("failed")).first()[:] == (75, 25)


def test_queue_stream_equals_replay(spark, tmp_path):
    kinds = ["seed", "claim", "progress", "complete", "release", "fail", "requeue"]
    rows = [(j, float(t), t, kinds[(j * 5 + t * t) % 7] if t else "seed", (j + t) % 2, 1.0, f"c{t}" if t % 4 == 0 else None) for j in range(6) for t in range(30)]
    events = spark.createDataFrame(rows, EVENT)
    for part in range(3):
        events.where(f"at >= {part * 10} and at < {part * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = streams.queue_stream(streams.stream(spark, str(tmp_path / "in"), EVENT))
    streams.run(streams.committed(out, str(tmp_path / "out"), str(tmp_path / "cp")).outputMode("update"))
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("job").agg(F.max_by(F.struct("state", "attempts", "produced", "cursor", "refused"), "batch").alias("s")).select("job", "s.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, jobqueue.replay(events).select("job", "state", "attempts", "produced", "cursor", "refused").collect()))
