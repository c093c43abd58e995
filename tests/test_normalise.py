from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import normalise as N


def pages(spark, source, *items):
    return spark.createDataFrame([(source, json.dumps(x)) for x in items], "source string, item string")


def page(**more):
    info = {"width": 1000, "height": 800, "mime": "image/jpeg", "url": "https://h/o.jpg?utm=1", "thumburl": "https://h/t.jpg", "extmetadata": {"LicenseShortName": {"value": "CC BY-SA 4.0"}, "Artist": {"value": "<b>Ann</b>"}, "Categories": {"value": "a|b"}}}
    return {"pageid": 7, "title": "File:B  x.jpg", "imageinfo": [info | more]}


def test_commons(spark):
    r = N.normalised(pages(spark, "commons", page())).first()
    assert (r.image_id, r.title, r.creator, r.license_class, r.full_url, r.tags) == ("commons:7", "B x.jpg", "Ann", "share_alike", "https://h/o.jpg", "a, b")
    dropped = pages(spark, "commons", page(mime="image/gif"), page(width=300), page(width=9000), page(thumburl=""), {"pageid": 1, "title": "x"})
    assert N.commons(dropped).count() == 0
    assert N.commons(pages(spark, "commons", page()), end="B").count() == 0
    assert N.commons(pages(spark, "commons", page()), end="C").count() == 1


def test_other_catalogues(spark):
    rows = N.normalised(
        pages(spark, "openverse", {"id": "o", "license": "by", "license_version": "2.0", "url": "https://h/u.jpg"}, {"id": "p", "license": "by-nc", "url": "u"})
        .unionAll(pages(spark, "nasa", {"data": [{"nasa_id": "n", "title": "T", "keywords": ["k", "l"]}], "links": [{"href": "https://h/x~thumb.jpg"}, {"href": "https://h/x~medium.jpg", "render": "image"}]}, {"data": []}))
        .unionAll(pages(spark, "met", {"objectID": 3, "isPublicDomain": True, "primaryImage": "https://h/3.jpg", "culture": "C", "department": "D", "objectDate": "", "medium": "M"}, {"objectID": 4, "isPublicDomain": False}))
        .unionAll(pages(spark, "wellcome", {"id": "w", "locations": [{"url": "https://h/iiif/info.json", "license": {"id": "CC-BY"}}], "source": {"id": "s", "title": "T"}}, {"id": "v", "locations": []}))
    )
    got = {r.image_id: r for r in rows.collect()}
    assert set(got) == {"openverse:o", "nasa:n", "met:3", "wellcome:w"}
    assert (got["openverse:o"].license, got["openverse:o"].thumb_origin, got["openverse:o"].width) == ("CC BY 2.0", "https://h/u.jpg", 0)
    assert (got["nasa:n"].full_url, got["nasa:n"].tags) == ("https://h/x~orig.jpg", "k, l")
    assert (got["met:3"].creator, got["met:3"].tags) == ("C", "D, M")
    assert (got["wellcome:w"].license, got["wellcome:w"].thumb_origin) == ("CC BY", "https://h/iiif/full/400,/0/default.jpg")


@pytest.mark.parametrize(("url", "w", "h", "reason"), [("http://h/x", 900, 900, "url_or_id"), (None, 900, 900, "url_or_id"), ("https://h/x", None, 900, "dimensions_unknown"), ("https://h/x", 0, 900, "dimensions_unknown"), ("https://h/x", 479, 900, "small"), ("https://h/x", 600, 600, "small"), ("https://h/x", 2000, 600, "aspect"), ("https://h/x", 900, 600, None)])
def test_reject_reasons(spark, url, w, h, reason):
    df = spark.createDataFrame([(url, w, h)], "u string, w int, h int")
    assert df.select(N.rejected(F.col("u"), F.col("w"), F.col("h"))).first()[0] == reason
