from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import functions as F

from lanternfish.functions import maths as M
from lanternfish.functions import text as X


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_text_forms(spark):
    assert one(spark, X.clean_text, "<div class='fn'> Water Drops</div>") == "Water Drops"
    assert one(spark, X.clean_text, "  a   b  ") == "a b"
    assert one(spark, X.clean_text, None) == ""
    assert one(spark, X.strip_tags, "a<br>b ") == "ab"
    assert one(spark, X.plain_text, "Caf&eacute; <b>x</b>&amp;y") == "Café x &y"
    assert one(spark, X.canonical_query, "  Self-Made, MAN! ") == "selfmade man"
    assert one(spark, X.nfc, "é") == "é"
    for title, stem in (("Foo - page 12.jpg", "foo"), ("Foo (3).PNG", "foo"), ("Foo no. 7", "foo"), ("Plain", "plain"), (None, "")):
        assert one(spark, X.series_stem, title) == stem


def test_license_classes(spark):
    for value, kind in (("CC0 1.0", "public_domain"), ("pd", "public_domain"), ("CC BY-SA 4.0", "share_alike"), ("Share Alike", "share_alike"), ("CC BY 4.0", "attribution"), ("", "attribution"), (None, "attribution")):
        assert one(spark, X.license_class, value) == kind


def test_urls(spark):
    assert one(spark, X.clean_url, "https://a.b/c?d#e") == "https://a.b/c"
    assert one(spark, X.url_host, "https://A.b:8080/c") == "a.b:8080"
    assert one(spark, X.url_host, "nothing") == "unknown"
    assert one(spark, X.url_host, None) == "unknown"
    for url, good in (("https://a.b/c", True), ("http://a.b/c", False), ("https://u@a.b/c", False), ("https:///c", False)):
        assert (one(spark, X.secure_url, url) == url) is good
    assert one(spark, X.thumbnail_path, "https://m.example/o/7.jpg?v=2") == "https://m.example/t/7/800px.jpg"
    assert one(spark, lambda x: X.wider_rendition(x, F.lit(5000)), "https://m.example/t/7/800px.jpg") == "https://m.example/t/7/3840px.jpg"
    assert one(spark, lambda x: X.wider_rendition(x, F.lit(3840)), "https://m.example/t/7/800px.jpg") == ""
    assert one(spark, lambda x: X.wider_rendition(x, F.lit(5000)), "https://m.example/t/7/800px.gif") == ""
    assert one(spark, X.percent_encoded, "a b/c") == "a%20b%2Fc"


def test_identity(spark):
    namespace = uuid.UUID(X.URL_NAMESPACE)
    for name in ("commons:1", "ov:ü", ""):
        assert one(spark, X.uuid5, name) == str(uuid.uuid5(namespace, name))
    assert one(spark, lambda x: X.unit_hash(F.lit("b"), x), '{"a":1}') == hashlib.sha256(b'b|{"a":1}').hexdigest()
    h = hashlib.md5(b"met_1").hexdigest()
    assert one(spark, X.object_key, "met:1") == f"t/{h[:2]}/{h[2:4]}/met_1.webp"


def test_numbers(spark):
    assert one(spark, lambda x: M.retry_at(x, F.lit(100.0)), "5") == 105
    assert one(spark, lambda x: M.retry_at(x, F.lit(100.0)), "-5") == 100
    assert one(spark, lambda x: M.retry_at(x, F.lit(100.0)), "soon") == 160
    assert one(spark, lambda x: M.retry_at(x, F.lit(100.0)), "Thu, 01 Jan 1970 00:10:00 GMT") == 600
    for headers, seconds in (({}, 3.3), ({"x-ratelimit-limit-burst": "20/min"}, 3.3), ({"x-ratelimit-limit-burst": "100/min"}, 2 / 3), ({"x-ratelimit-limit-burst": "10/min"}, 6.6)):
        assert abs(one(spark, M.request_interval, headers, "map<string,string>") - seconds) < 1e-9
    assert one(spark, lambda x: M.backoff(x, 30.0), 9, "int") == 30
    assert one(spark, M.unit, [3.0, 4.0], "array<float>") == [0.6, 0.8]
    assert one(spark, M.unit, [0.0, 0.0], "array<float>") is None
    assert one(spark, lambda x: M.sigmoid(x, 1.0, 0.0), -1e9, "double") == 1 / (1 + math.exp(60))
    for done, queued, goal, code in ((1, 1, False, 75), (1, 0, False, 0), (5, 1, False, 0), (1, 1, True, 0)):
        assert one(spark, lambda x, q=queued, g=goal: M.exit_code(x, F.lit(5), F.lit(q), F.lit(g)), done, "int") == code


def test_renditions(spark):
    """From the thumbnail's address, else the original's; none for small, moving or foreign originals."""
    hosts, host, marker = ("thumb.media.example", "upload.media.example"), "upload.media.example", "/wikipedia/commons/"
    base = f"https://{host}{marker}"
    cases = [
        ("5000", f"{base}thumb/a/ab/Mill.jpg/500px-Mill.jpg?x=1", "", f"{base}thumb/a/ab/Mill.jpg/3840px-Mill.jpg"),
        ("5000", f"https://thumb.media.example{marker}thumb/a/ab/Map.tif/lossy-page1-500px-Map.tif.jpg", "", f"https://thumb.media.example{marker}thumb/a/ab/Map.tif/lossy-page1-3840px-Map.tif.jpg"),
        ("5000", "", f"{base}a/ab/Mill.jpg?utm=1", f"{base}thumb/a/ab/Mill.jpg/3840px-Mill.jpg"),
        ("3840", f"{base}thumb/a/ab/Mill.jpg/500px-Mill.jpg", "", ""),
        ("wide", f"{base}thumb/a/ab/Mill.jpg/500px-Mill.jpg", "", ""),
        ("5000", f"{base}thumb/a/ab/Turn.gif/500px-Turn.gif", f"{base}a/ab/Turn.gif", ""),
        ("5000", f"{base}thumb/a/ab/Plan.svg/500px-Plan.svg.png", f"{base}a/ab/Plan.svg", ""),
        ("5000", "https://elsewhere.example/thumb/500px-Mill.jpg", "https://elsewhere.example/wikipedia/commons/a/ab/Mill.jpg", ""),
        ("5000", "", f"{base}thumb/a/ab/Mill.jpg/500px-Mill.jpg", ""),
        (None, None, None, ""),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, w string, t string, o string, want string")
    got = df.withColumn("got", X.rendition(F.col("w"), F.col("t"), F.col("o"), hosts, host, marker)).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_shown_thumbnails(spark):
    df = spark.createDataFrame([("k/1.webp", "o"), ("", "o"), ("https://p/x", "o"), ("https://p/x", ""), (None, None)], "c string, o string")
    assert [r.x for r in df.select(X.shown_thumbnail(F.col("c"), F.col("o"), "b/").alias("x")).collect()] == ["b/k/1.webp", "o", "o", "https://p/x", ""]


def test_derivatives(spark):
    key, thumb = X.derivative(F.col("u"), F.col("s"), F.col("l"), "site", "static.example")
    rows = [("https://live.static.example/65535/123_abC_b.jpg", "site", "l1"), ("https://live.static.example/9_x.gif", "site", "l1"), ("https://static.example.org/123_abc_b.jpg", "site", "l1"), ("https://live.static.example/1_a.png", "other", "l1")]
    got = [tuple(r) for r in spark.createDataFrame(rows, "u string, s string, l string").select(key, thumb).collect()]
    import hashlib

    digest = hashlib.sha256(b"l1").hexdigest()
    assert got == [("site:123", "https://live.static.example/65535/123_abC_n.jpg"), (f"site:{digest}", rows[1][0]), (f"site:{digest}", rows[2][0]), (f"other:{digest}", rows[3][0])]


def test_unit_hashes_do_not_depend_on_spelling(spark):
    df = spark.createDataFrame([('{"b": 1, "a":"é"}',), ('{"a":"\\u00e9","b":1}',), ("{broken",), (None,)], "u string")
    got = [r.x for r in df.select(X.unit_hash(F.lit("x"), F.col("u")).alias("x")).collect()]
    import hashlib

    assert got[0] == got[1] == hashlib.sha256('x|{"a":"\\u00e9","b":1}'.encode()).hexdigest()
    assert got[2] == hashlib.sha256(b"x|{broken").hexdigest() and got[3] is None


def test_license_class_is_trimmed(spark):
    df = spark.createDataFrame([(" PD ",), ("\tpd",), ("pd-usgov",), ("",)], "l string")
    assert [r.x for r in df.select(X.license_class(F.col("l")).alias("x")).collect()] == ["public_domain", "public_domain", "attribution", "attribution"]
