"""Queries on the normalisers of the catalogues: items are built as JSON from the crawler's rows, and what comes back is compared with the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions import maths
from lanternfish.functions import text as X
from lanternfish.operators import normalise
from lanternfish.plans.corpus import _CLASS, _clean
from lanternfish.plans.frames import LATEST, latest_images
from lanternfish.plans.registry import query
from lanternfish.session import table

_BASE = f"{LATEST}, base AS (SELECT *, split_part(id, ':', 2) AS k, coalesce(width, 0) AS w, coalesce(height, 0) AS h, CASE WHEN license ILIKE '%cc0%' THEN 'cc0' WHEN license ILIKE '%mark%' THEN 'pdm' WHEN license ILIKE '%by%' THEN 'by' END AS lic FROM latest)"
_FITS = "((w = 0 OR h = 0) OR (least(w, h) >= 320 AND greatest(w, h) <= 8 * least(w, h)))"
_KNOWN = "(w > 0 AND h > 0 AND least(w, h) >= 320 AND greatest(w, h) <= 8 * least(w, h))"
_URL = "regexp_replace({0}, '[?#].*$', '')"
_STRIP = "coalesce(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '^[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+|[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+$', '', 'g'), '')"
_NAMES = "CASE lic WHEN 'cc0' THEN 'CC0 1.0' WHEN 'pdm' THEN 'Public Domain Mark 1.0' WHEN 'by' THEN {0} END"


def _row(image_id: str, license_: str, license_class: str, where: str, **columns: str) -> str:
    """The canonical row in SQL; what isn't given is unknown."""
    parts = {"image_id": image_id, "title": "''", "creator": "''", "license": license_, "license_class": license_class, "license_url": "''", "source_url": "''", "full_url": "''", "thumb_origin": "''", "width": "w", "height": "h", "mime": "''", "sha1": "''", "description": "''", "tags": "''"}
    return "SELECT " + ", ".join(f"{v} AS {n}" for n, v in (parts | columns).items()) + f" FROM base WHERE {where}"


def _base(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("license")
    lic = F.when(F.contains(low, F.lit("cc0")), "cc0").when(F.contains(low, F.lit("mark")), "pdm").when(F.contains(low, F.lit("by")), "by")
    return latest_images(spark, sf).withColumn("k", F.element_at(F.split("id", ":"), 2)).withColumn("lic", lic)


_TITLE, _CREATOR = f"substr({_clean('title')}, 1, 300)", f"substr({_clean('creator')}, 1, 180)"
_OPENVERSE = _row("'openverse:' || k", _NAMES.format("'CC BY 4.0'"), "CASE WHEN lic = 'by' THEN 'attribution' ELSE 'public_domain' END", f"lic IS NOT NULL AND coalesce(full_url, '') <> '' AND {_FITS}", title=_TITLE, creator=_CREATOR, license_url="coalesce(license_url, '')", source_url="coalesce(source_url, '')", full_url="full_url", thumb_origin="coalesce(nullif(thumb_url, ''), full_url)")


def _openverse(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.col("k").alias("id"), "title", "creator", F.upper("lic").alias("license"), F.lit("4.0").alias("license_version"), "license_url", F.col("source_url").alias("foreign_landing_url"), F.col("full_url").alias("url"), F.col("thumb_url").alias("thumbnail"), "width", "height")).alias("item"))


@query(f"WITH {_BASE} {_OPENVERSE}")
def rows_of_openverse(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.openverse(_openverse(_base(spark, sf)))


_MEDIUM = "regexp_replace(full_url, '\\.([a-z]+)$', '~medium.\\1')"
_NASA = _row("'nasa:' || k", "'Public domain'", "'public_domain'", f"coalesce(full_url, '') <> '' AND k <> '' AND {_FITS}", title=_TITLE, creator="'NASA'", full_url=f"replace({_MEDIUM}, '~medium.', '~orig.')", thumb_origin=_MEDIUM, description=f"substr({_clean('tags')}, 1, 400)", tags="coalesce(topic || ', archive', 'archive')")


def _nasa(rows: DataFrame) -> DataFrame:
    data = F.array(F.struct(F.col("k").alias("nasa_id"), "title", F.col("tags").alias("description"), F.array_compact(F.array("topic", F.lit("archive"))).alias("keywords")))
    links = F.array(F.struct(F.lit("").alias("href"), F.lit("image").alias("render"), F.lit(1).alias("width"), F.lit(1).alias("height")), F.struct(F.regexp_replace("full_url", r"\.([a-z]+)$", "~medium.$1").alias("href"), F.lit("image").alias("render"), "width", "height"))
    return rows.select(F.to_json(F.struct(data.alias("data"), links.alias("links"))).alias("item"))


@query(f"WITH {_BASE} {_NASA}")
def rows_of_nasa(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.nasa(_nasa(_base(spark, sf)))


_MET = _row("'met:' || length(id)::VARCHAR", "'CC0 1.0'", "'public_domain'", "h % 2 = 0 AND coalesce(full_url, '') <> ''", title=_TITLE, creator=f"substr({_clean("coalesce(nullif(creator, ''), 'unknown maker')")}, 1, 180)", source_url="coalesce(source_url, '')", full_url="full_url", thumb_origin="coalesce(nullif(thumb_url, ''), full_url)", width="0", height="0", tags="substr(concat_ws(', ', nullif(topic, ''), 'oil'), 1, 300)")


def _met(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.length("id").alias("objectID"), (F.coalesce("height", F.lit(0)) % 2 == 0).alias("isPublicDomain"), F.col("full_url").alias("primaryImage"), F.col("thumb_url").alias("primaryImageSmall"), "title", F.col("creator").alias("artistDisplayName"), F.lit("unknown maker").alias("culture"), F.col("source_url").alias("objectURL"), F.col("topic").alias("department"), F.lit("").alias("objectDate"), F.lit("oil").alias("medium"))).alias("item"))


@query(f"WITH {_BASE} {_MET}")
def rows_of_met(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.met(_met(_base(spark, sf)))


_WELLCOME = _row("'wellcome:' || k", _NAMES.format("coalesce(nullif(license, ''), 'CC BY')"), "CASE WHEN lic = 'by' THEN 'attribution' ELSE 'public_domain' END", "lic IS NOT NULL AND full_url IS NOT NULL", title=_TITLE, creator=f"substr({_clean("coalesce(nullif(creator, ''), 'Wellcome Collection')")}, 1, 180)", license_url="coalesce(license_url, '')", full_url="full_url || '/full/1600,/0/default.jpg'", thumb_origin="full_url || '/full/400,/0/default.jpg'", width="0", height="0")


def _wellcome(rows: DataFrame) -> DataFrame:
    code = F.when(F.col("lic") == "by", "cc-by").otherwise(F.col("lic"))
    place = F.struct(F.concat("full_url", F.lit("/info.json")).alias("url"), F.col("creator").alias("credit"), F.struct(code.alias("id"), F.col("license").alias("label"), F.col("license_url").alias("url")).alias("license"))
    return rows.select(F.to_json(F.struct(F.col("k").alias("id"), F.array(place).alias("locations"), F.struct(F.col("k").alias("id"), "title").alias("source"))).alias("item"))


@query(f"WITH {_BASE} {_WELLCOME}")
def rows_of_wellcome(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.wellcome(_wellcome(_base(spark, sf)))


_COMMONS = _row("'commons:' || length(id)::VARCHAR", _STRIP.format("license"), _CLASS.format(f"({_STRIP.format('license')})"), f"coalesce(thumb_url, '') <> '' AND w % 5 <> 0 AND {_KNOWN} AND replace(coalesce(title, ''), ' ', '_') < 'm'", title=_TITLE, creator=f"substr({_STRIP.format('creator')}, 1, 180)", license_url=_STRIP.format("license_url"), full_url=f"coalesce({_URL.format('full_url')}, '')", thumb_origin=_URL.format("thumb_url"), mime="'image/jpeg'", sha1="md5(id)", description=f"substr({_STRIP.format('tags')}, 1, 400)", tags="coalesce(topic || ', b', '')")


def _commons(rows: DataFrame) -> DataFrame:
    value = lambda c: F.struct(c.alias("value"))
    meta = F.create_map(F.lit("LicenseShortName"), value(F.col("license")), F.lit("Artist"), value(F.col("creator")), F.lit("LicenseUrl"), value(F.col("license_url")), F.lit("ImageDescription"), value(F.col("tags")), F.lit("Categories"), value(F.concat("topic", F.lit("|b"))))
    info = F.struct("width", "height", F.col("full_url").alias("url"), F.col("thumb_url").alias("thumburl"), F.when(F.coalesce("width", F.lit(0)) % 5 == 0, "image/gif").otherwise("image/jpeg").alias("mime"), F.md5("id").alias("sha1"), meta.alias("extmetadata"))
    return rows.select(F.to_json(F.struct(F.length("id").alias("pageid"), F.concat(F.lit("File:"), "title").alias("title"), F.array(info).alias("imageinfo"))).alias("item"))


@query(f"WITH {_BASE} {_COMMONS}")
def rows_of_commons(spark: SparkSession, sf: str) -> DataFrame:
    """Pages before the end of the range that is walked, of three kinds of files."""
    return normalise.commons(_commons(_base(spark, sf)), "m")


@query(f"WITH {_BASE}, a AS ({_OPENVERSE}), b AS ({_NASA}), c AS ({_MET}), d AS ({_WELLCOME}) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d")
def rows_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """Items of several catalogues in one table."""
    rows, items = _base(spark, sf), None
    for source, shape in (("openverse", _openverse), ("nasa", _nasa), ("met", _met), ("wellcome", _wellcome)):
        part = shape(rows).select(F.lit(source).alias("source"), "item")
        items = part if items is None else items.unionByName(part)
    return normalise.normalised(items)


@query(f"WITH {LATEST} SELECT id, {_STRIP.format('title')} AS title FROM latest")
def stripped_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles whose tags vanish; white space inside stays."""
    return latest_images(spark, sf).select("id", X.strip_tags(F.col("title")).alias("title"))


@query("SELECT id, updated_at + CASE id % 3 WHEN 0 THEN greatest(0, id % 90 - 20) WHEN 1 THEN 60 ELSE greatest(0, 1742000000 - updated_at) END AS at FROM jobs WHERE updated_at IS NOT NULL")
def retry_times(spark: SparkSession, sf: str) -> DataFrame:
    """When to try again: after the seconds of a header, by default, or at its date."""
    header = F.when(F.col("id") % 3 == 0, (F.col("id") % 90 - 20).cast("string")).when(F.col("id") % 3 == 1, "soon").otherwise("Sat, 15 Mar 2025 00:53:20 GMT")
    return table(spark, sf, "jobs").where("updated_at is not null").select("id", maths.retry_at(header, F.col("updated_at")).alias("at"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 3.3 ELSE round(greatest(2.0 / 3, 60.0 / (id % 120 + 1) * 1.1), 9) END::DOUBLE AS wait FROM jobs")
def request_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds between requests that advertised limits allow; without one, the default."""
    limit = F.concat((F.col("id") % 120 + 1).cast("string"), F.lit("/min"))
    headers = F.when(F.col("id") % 4 == 0, F.create_map(F.lit("x-other"), limit)).otherwise(F.create_map(F.lit("x-ratelimit-limit-anon-burst"), limit, F.lit("x-ratelimit-limit-anon-sustained"), F.lit("9/day")))
    return table(spark, sf, "jobs").select("id", F.round(maths.request_interval(headers), 9).alias("wait"))
