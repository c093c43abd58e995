"""Records of several catalogues brought to one row shape, and the rules that drop them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.text import clean_text, clean_url, license_class, secure_url, strip_tags
from lanternfish.schema import IMAGE

#: Item schemas of the catalogues, as they come in JSON.
ITEMS = {
    "commons": "pageid bigint, title string, imageinfo array<struct<width: int, height: int, url: string, thumburl: string, mime: string, sha1: string, extmetadata: map<string, struct<value: string>>>>",
    "openverse": "id string, title string, creator string, license string, license_version string, license_url string, foreign_landing_url string, url string, thumbnail string, width int, height int",
    "nasa": "data array<struct<nasa_id: string, title: string, description: string, keywords: array<string>>>, links array<struct<href: string, render: string, width: int, height: int>>",
    "met": "objectID bigint, isPublicDomain boolean, primaryImage string, primaryImageSmall string, title string, artistDisplayName string, culture string, objectURL string, department string, objectDate string, medium string",
    "wellcome": "id string, locations array<struct<url: string, credit: string, license: struct<id: string, label: string, url: string>>>, source struct<id: string, title: string>",
}


def fits(width: Column, height: Column, least: int = 320, aspect: int = 8, unknown: bool = True) -> Column:
    """Large enough and not too narrow. A side of 0 is unknown and passes if ``unknown``."""
    known = (width > 0) & (height > 0)
    good = (F.least(width, height) >= least) & (F.greatest(width, height) <= aspect * F.least(width, height))
    return (~known & F.lit(unknown)) | (known & good)


def rejected(url: Column, width: Column, height: Column, least: int = 480, wide: int = 640, aspect: int = 3) -> Column:
    """The first rule a record fails, in order; null if none."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    low, high = F.least(w, h), F.greatest(w, h)
    return F.when(secure_url(F.coalesce(url, F.lit(""))) == "", "url_or_id").when(low <= 0, "dimensions_unknown").when((low < least) | (high < wide), "small").when(high > aspect * low, "aspect")


def rejected_item(source: Column, wanted: Column, licence: Column, flagged: Column, url: Column, landing: Column, key: Column, width: Column, height: Column, sources: tuple[str, ...], licences: tuple[str, ...]) -> Column:
    """The first rule an item of an aggregator fails, in order: source, license, sensitive_metadata, url_or_id, dimensions_unknown, small, aspect; null if none. Sizes may be text; what is no number is unknown."""
    w, h = width.try_cast("double"), height.try_cast("double")
    named = (secure_url(F.coalesce(url, F.lit(""))) != "") & (secure_url(F.coalesce(landing, F.lit(""))) != "") & (F.coalesce(key, F.lit("")) != "")
    first = F.when(~F.coalesce((source == wanted) & source.isin(*sources), F.lit(False)), "source").when(~F.coalesce(licence.isin(*licences), F.lit(False)), "license")
    first = first.when(F.coalesce(flagged, F.lit(False)), "sensitive_metadata").when(~named, "url_or_id")
    return first.when(w.isNull() | h.isNull(), "dimensions_unknown").otherwise(rejected(url, w, h))


#: Licence classes that may be asked for.
CLASSES = ("public_domain", "attribution", "share_alike")


def asked_classes(asked: str) -> list[str]:
    """The classes of a comma-separated list, in order, each once; an unknown one is an error."""
    wanted = sorted({c for c in asked.split(",") if c})
    if unknown := set(wanted) - set(CLASSES):
        raise ValueError(f"unknown licence classes: {', '.join(sorted(unknown))}")
    return wanted


def in_classes(value: Column, asked: str) -> Column:
    """Any of the asked classes; without one, all."""
    wanted = asked_classes(asked)
    return value.isin(*wanted) if wanted else F.lit(True)


def within_bytes(value: Column, most: int = 15_000_000) -> Column:
    return F.octet_length(value) <= most


def short_meta(images: DataFrame) -> DataFrame:
    """(i, t, c, w): id, title, creator and width of images under short names, as a static page carries them."""
    return images.select(F.col("id").alias("i"), F.substring(clean_text(F.col("title")), 1, 300).alias("t"), F.substring(clean_text(F.col("creator")), 1, 120).alias("c"), F.coalesce("width", F.lit(0)).alias("w"))


def flagged_item(mature: Column, sensitivity: Column) -> Column:
    """An item that its source marks as mature or sensitive; unmarked ones are not."""
    return F.coalesce(mature, F.lit(False)) | F.coalesce(F.size(sensitivity) > 0, F.lit(False))


def _shaped(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of the canonical row; what a source doesn't give is '' or 0."""
    empty = {f.name: F.lit("" if f.dataType.typeName() == "string" else 0).cast(f.dataType) for f in IMAGE.fields}
    return df.select(*[F.coalesce(columns.get(f.name, empty[f.name]), empty[f.name]).cast(f.dataType).alias(f.name) for f in IMAGE.fields])


def image_rows(images: DataFrame) -> DataFrame:
    """Canonical rows of the crawler's table."""
    rows = images.withColumns({"width": F.coalesce("width", F.lit(0)), "height": F.coalesce("height", F.lit(0))})
    c = F.col
    return _shaped(
        rows.where(fits(c("width"), c("height"))), image_id=c("id"), title=F.substring(clean_text(c("title")), 1, 300), creator=F.substring(clean_text(c("creator")), 1, 180), license=c("license"),
        license_class=license_class(c("license")), license_url=c("license_url"), source_url=c("source_url"), full_url=clean_url(c("full_url")), thumb_origin=clean_url(c("thumb_url")),
        width=c("width"), height=c("height"), tags=F.substring(clean_text(c("tags")), 1, 300),
    )


def commons(items: DataFrame, end: str | None = None) -> DataFrame:
    """Pages of a wiki, those before the end of the range that is walked."""
    p = items.select(F.from_json("item", ITEMS["commons"]).alias("p")).select("p.*")
    p = p.withColumn("i", F.try_element_at("imageinfo", F.lit(1))).withColumn("name", F.regexp_replace(F.coalesce("title", F.lit("")), "^File:", ""))
    meta = lambda k: strip_tags(F.try_element_at(F.col("i.extmetadata"), F.lit(k))["value"])
    p = p.where(F.col("i.mime").isin("image/jpeg", "image/png", "image/webp") & (F.coalesce("i.thumburl", F.lit("")) != "") & fits(F.coalesce("i.width", F.lit(0)), F.coalesce("i.height", F.lit(0)), unknown=False))
    if end is not None:
        p = p.where(F.replace("name", F.lit(" "), F.lit("_")) < end)
    lic = meta("LicenseShortName")
    return _shaped(
        p, image_id=F.concat(F.lit("commons:"), F.col("pageid").cast("string")), title=F.substring(clean_text(F.col("name")), 1, 300), creator=F.substring(meta("Artist"), 1, 180), license=lic, license_class=license_class(lic),
        license_url=meta("LicenseUrl"), full_url=clean_url(F.col("i.url")), thumb_origin=clean_url(F.col("i.thumburl")), width=F.col("i.width"), height=F.col("i.height"), mime=F.col("i.mime"), sha1=F.col("i.sha1"),
        description=F.substring(meta("ImageDescription"), 1, 400), tags=F.substring(F.replace(meta("Categories"), F.lit("|"), F.lit(", ")), 1, 300),
    )


def openverse(items: DataFrame) -> DataFrame:
    """Items of an aggregator of open works; the licence is an enumeration."""
    x = items.select(F.from_json("item", ITEMS["openverse"]).alias("x")).select("x.*").withColumn("l", F.lower("license"))
    name = F.when(F.col("l") == "cc0", "CC0 1.0").when(F.col("l") == "pdm", "Public Domain Mark 1.0").when(F.col("l") == "by", F.trim(F.concat(F.lit("CC BY "), F.coalesce("license_version", F.lit("")))))
    x = x.withColumn("name", name).where(F.col("name").isNotNull() & (F.coalesce("url", F.lit("")) != "") & fits(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))))
    return _shaped(
        x, image_id=F.concat(F.lit("openverse:"), F.col("id")), title=F.substring(clean_text(F.col("title")), 1, 300), creator=F.substring(clean_text(F.col("creator")), 1, 180), license=F.col("name"),
        license_class=F.when(F.col("l") == "by", "attribution").otherwise("public_domain"), license_url=F.col("license_url"), source_url=F.col("foreign_landing_url"), full_url=F.col("url"),
        thumb_origin=F.coalesce(F.nullif("thumbnail", F.lit("")), "url"), width=F.col("width"), height=F.col("height"),
    )


def nasa(items: DataFrame) -> DataFrame:
    """Items of an image library: the first link that is drawn as an image, else the first; its name gives the archived file's."""
    x = items.select(F.from_json("item", ITEMS["nasa"]).alias("x")).select(F.try_element_at("x.data", F.lit(1)).alias("d"), F.filter("x.links", lambda k: F.coalesce(k["href"], F.lit("")) != "").alias("k"))
    x = x.withColumn("m", F.coalesce(F.try_element_at(F.filter("k", lambda k: k["render"] == "image"), F.lit(1)), F.try_element_at("k", F.lit(1))))
    x = x.where((F.coalesce("d.nasa_id", F.lit("")) != "") & F.col("m").isNotNull() & fits(F.coalesce("m.width", F.lit(0)), F.coalesce("m.height", F.lit(0))))
    words = F.array_join(F.slice(F.coalesce("d.keywords", F.array().cast("array<string>")), 1, 20), ", ")
    return _shaped(
        x, image_id=F.concat(F.lit("nasa:"), F.col("d.nasa_id")), title=F.substring(clean_text(F.col("d.title")), 1, 300), creator=F.lit("NASA"), license=F.lit("Public domain"), license_class=F.lit("public_domain"),
        full_url=F.regexp_replace("m.href", r"~(?:medium|small|thumb)\.", "~orig."), thumb_origin=F.col("m.href"), width=F.col("m.width"), height=F.col("m.height"),
        description=F.substring(clean_text(F.col("d.description")), 1, 400), tags=F.substring(words, 1, 300),
    )


def met(items: DataFrame) -> DataFrame:
    """Objects of a museum, those in the public domain with an image."""
    x = items.select(F.from_json("item", ITEMS["met"]).alias("x")).select("x.*").where(F.coalesce("isPublicDomain", F.lit(False)) & (F.coalesce("primaryImage", F.lit("")) != ""))
    given = F.filter(F.array("department", "objectDate", "medium"), lambda v: F.coalesce(v, F.lit("")) != "")
    return _shaped(
        x, image_id=F.concat(F.lit("met:"), F.col("objectID").cast("string")), title=F.substring(clean_text(F.col("title")), 1, 300), creator=F.substring(clean_text(F.coalesce(F.nullif("artistDisplayName", F.lit("")), "culture")), 1, 180),
        license=F.lit("CC0 1.0"), license_class=F.lit("public_domain"), source_url=F.col("objectURL"), full_url=F.col("primaryImage"), thumb_origin=F.coalesce(F.nullif("primaryImageSmall", F.lit("")), "primaryImage"), tags=F.substring(F.array_join(given, ", "), 1, 300),
    )


def wellcome(items: DataFrame) -> DataFrame:
    """Works of a library whose images have an address of the image interface, from which two sizes follow."""
    x = items.select(F.from_json("item", ITEMS["wellcome"]).alias("x")).select("x.id", "x.source", F.try_element_at("x.locations", F.lit(1)).alias("p"))
    code = F.lower("p.license.id")
    name = F.when(code == "pdm", "Public Domain Mark 1.0").when(code == "cc0", "CC0 1.0").when(code == "cc-by", F.coalesce(F.nullif("p.license.label", F.lit("")), F.lit("CC BY")))
    x = x.withColumns({"name": name, "by": code == "cc-by"}).where(F.col("name").isNotNull() & F.col("p.url").endswith("/info.json"))
    base = F.regexp_replace("p.url", "/info[.]json$", "")
    return _shaped(
        x, image_id=F.concat(F.lit("wellcome:"), F.col("id")), title=F.substring(clean_text(F.col("source.title")), 1, 300), creator=F.substring(clean_text(F.coalesce(F.nullif("p.credit", F.lit("")), F.lit("Wellcome Collection"))), 1, 180), license=F.col("name"),
        license_class=F.when(F.col("by"), "attribution").otherwise("public_domain"), license_url=F.col("p.license.url"), full_url=F.concat(base, F.lit("/full/1600,/0/default.jpg")), thumb_origin=F.concat(base, F.lit("/full/400,/0/default.jpg")),
    )


SOURCES = {"commons": commons, "openverse": openverse, "nasa": nasa, "met": met, "wellcome": wellcome}


def normalised(pages: DataFrame) -> DataFrame:
    """Items (source, item) of all catalogues as canonical rows."""
    parts = [f(pages.where(F.col("source") == s).select("item")) for s, f in SOURCES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
