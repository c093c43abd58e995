"""Queries on normalisation, keyed writes, identity and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions import text as X
from lanternfish.operators import packed_values, relational, statistics
from lanternfish.operators.normalise import image_rows, rejected
from lanternfish.functions.maths import is_valid
from lanternfish.plans.frames import LATEST, SIZE, latest_images
from lanternfish.plans.registry import query
from lanternfish.session import table

_WS = "'[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+'"


def _clean(c: str) -> str:
    return f"coalesce(trim(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), {_WS}, ' ', 'g')), '')"


_CLASS = "CASE WHEN regexp_matches(lower(coalesce({0}, '')), 'cc0|public domain|pdm') OR regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g') = 'pd' THEN 'public_domain' WHEN list_contains(regexp_split_to_array(replace(lower(coalesce({0}, '')), '-', ' '), '\\s+'), 'sa') OR contains(lower(coalesce({0}, '')), 'share') THEN 'share_alike' ELSE 'attribution' END"
_URL = "regexp_replace({0}, '[?#].*$', '')"
_HOST = "coalesce(nullif(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ''), 'unknown')"


@query()
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_values.unpacked_several(table(spark, sf, "images"))


@query()
def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """All values, those that stand alone too."""
    return packed_values.unpacked(table(spark, sf, "images"))


@query(f"WITH {LATEST} SELECT id, {_clean('title')} AS title, {_clean('creator')} AS creator FROM latest")
def clean_titles(spark: SparkSession, sf: str) -> DataFrame:
    return latest_images(spark, sf).select("id", X.clean_text(F.col("title")).alias("title"), X.clean_text(F.col("creator")).alias("creator"))


@query()
def plain_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles without markup, with character references resolved; SQL has no table of their names."""
    return latest_images(spark, sf).select("id", X.plain_text(F.col("title")).alias("title"))


@query(f"WITH {LATEST} SELECT id, nfc_normalize(title) AS title FROM latest")
def composed_titles(spark: SparkSession, sf: str) -> DataFrame:
    return latest_images(spark, sf).select("id", X.nfc(F.col("title")).alias("title"))


@query(f"WITH {LATEST} SELECT id, trim(regexp_replace(translate(lower(coalesce(title, '')), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS canon FROM latest")
def canonical_titles(spark: SparkSession, sf: str) -> DataFrame:
    return latest_images(spark, sf).select("id", X.canonical_query(F.col("title")).alias("canon"))


@query(f"WITH {LATEST} SELECT id, substr(concat_ws(' ', nullif({_clean('title')}, ''), nullif({_clean('tags')}, '')), 1, 1400) AS search_text FROM latest")
def search_texts(spark: SparkSession, sf: str) -> DataFrame:
    return latest_images(spark, sf).select("id", X.search_text(F.col("title"), F.col("tags")).alias("search_text"))


@query(f"WITH {LATEST} SELECT {_CLASS.format('license')} AS license_class, count(*) AS n FROM latest WHERE license IS NOT NULL GROUP BY 1")
def license_classes(spark: SparkSession, sf: str) -> DataFrame:
    return latest_images(spark, sf).where("license is not null").groupBy(X.license_class(F.col("license")).alias("license_class")).agg(F.count("*").alias("n"))


@query(f"WITH {LATEST} SELECT id, {_URL.format('full_url')} AS url FROM latest")
def clean_urls(spark: SparkSession, sf: str) -> DataFrame:
    return latest_images(spark, sf).select("id", X.clean_url(F.col("full_url")).alias("url"))


@query(f"WITH {LATEST} SELECT {_HOST.format('full_url')} AS host, count(*) FILTER (state IN ('stored', 'embedded')) AS ok, count(*) FILTER (state = 'failed') AS failed, round(100.0::DOUBLE * count(*) FILTER (state = 'failed') / count(*), 6) AS failed_pct FROM latest GROUP BY 1")
def host_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_images(spark, sf).groupBy(X.url_host(F.col("full_url")).alias("host"))
    return rows.agg(F.count_if(F.col("state").isin("stored", "embedded")).alias("ok"), F.count_if(F.col("state") == "failed").alias("failed"), F.round(100.0 * F.count_if(F.col("state") == "failed") / F.count("*"), 6).alias("failed_pct"))


@query(f"WITH {LATEST} SELECT round(100.0::DOUBLE * avg(({_HOST.format('full_url')} = 'commons.media-host.example')::INT), 6) AS pct FROM latest")
def host_share(spark: SparkSession, sf: str) -> DataFrame:
    return latest_images(spark, sf).agg(F.round(100.0 * F.avg((X.url_host(F.col("full_url")) == "commons.media-host.example").cast("int")), 6).alias("pct"))


_THUMB = f"CASE WHEN regexp_matches(full_url, '/o/[^/?#]+\\.[A-Za-z]+') THEN regexp_replace({_URL.format('full_url')}, '/o/([^/]+)\\.([A-Za-z]+)$', '/t/\\1/800px.\\2') ELSE full_url END"
_WIDER = f"CASE WHEN width > 3840 AND NOT regexp_matches(lower({_URL.format('thumb_url')}), '\\.(gif|svg|svg\\.png)$') AND regexp_matches(thumb_url, '/[^/]*[0-9]+px[^/]*$') THEN regexp_replace({_URL.format('thumb_url')}, '[0-9]+px([^/]*)$', '3840px\\1') ELSE '' END"


@query(f"WITH {LATEST} SELECT id, {_THUMB} AS thumb, {_WIDER} AS rendition FROM latest")
def renditions(spark: SparkSession, sf: str) -> DataFrame:
    """Thumbnail derived from the original's URL, and the wider rendition where the original is wider than it."""
    return latest_images(spark, sf).select("id", X.thumbnail_path(F.col("full_url")).alias("thumb"), X.wider_rendition(F.col("thumb_url"), F.col("width")).alias("rendition"))


_FIT = "(width = 0 OR height = 0 OR (least(width, height) >= 320 AND greatest(width, height) <= 8 * least(width, height)))"


@query(f"""WITH {LATEST}, n AS (SELECT * REPLACE (coalesce(width, 0) AS width, coalesce(height, 0) AS height) FROM latest)
SELECT id AS image_id, substr({_clean('title')}, 1, 300) AS title, substr({_clean('creator')}, 1, 180) AS creator, coalesce(license, '') AS license, {_CLASS.format('license')} AS license_class, coalesce(license_url, '') AS license_url, coalesce(source_url, '') AS source_url, coalesce({_URL.format('full_url')}, '') AS full_url, coalesce({_URL.format('thumb_url')}, '') AS thumb_origin, width, height, '' AS mime, '' AS sha1, '' AS description, substr({_clean('tags')}, 1, 300) AS tags FROM n WHERE {_FIT}""")
def normalise_images(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical rows of the catalogue; unknown sizes pass."""
    return image_rows(latest_images(spark, sf))


@query(f"""WITH {LATEST}, r AS (SELECT split_part(id, ':', 1) AS source, CASE WHEN NOT regexp_matches(coalesce(full_url, ''), '^https://[^/?#@:]+(:[0-9]+)?([/?#]|$)') THEN 'url_or_id' WHEN coalesce(width, 0) <= 0 OR coalesce(height, 0) <= 0 THEN 'dimensions_unknown' WHEN least(width, height) < 480 OR greatest(width, height) < 640 THEN 'small' WHEN greatest(width, height) > 3 * least(width, height) THEN 'aspect' END AS reason FROM latest)
SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that each row fails, counted per source."""
    rows = latest_images(spark, sf).withColumn("reason", rejected(F.col("full_url"), F.col("width"), F.col("height")))
    return rows.groupBy(F.substring_index("id", ":", 1).alias("source"), F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT split_part(id, ':', 1) AS source, id, count(*) AS crawls FROM images WHERE id IS NOT NULL GROUP BY ALL) SELECT source, sum(crawls)::BIGINT AS raw, count(*) AS candidates, (sum(crawls) - count(*))::BIGINT AS duplicates FROM s GROUP BY source")
def source_rollup(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "images").where("id is not null").groupBy("id").agg(F.count("*").alias("crawls"))
    return per.groupBy(F.substring_index("id", ":", 1).alias("source")).agg(F.sum("crawls").alias("raw"), F.count("*").alias("candidates"), (F.sum("crawls") - F.count("*")).alias("duplicates"))


@query("SELECT state, count(*) AS n FROM images GROUP BY state")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "images").groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT fail_reason, count(*) AS n FROM images WHERE state = 'failed' GROUP BY fail_reason ORDER BY n DESC, fail_reason LIMIT 8")
def fail_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent reasons of failure: a report of eight."""
    return table(spark, sf, "images").where("state = 'failed'").groupBy("fail_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fail_reason").limit(8)


@query("SELECT count(*) AS rows, count(DISTINCT id) AS ids FROM images")
def corpus_size(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "images").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query()
def corpus_size_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Number of ids by a sketch, within about 2 percent."""
    return table(spark, sf, "images").agg(F.approx_count_distinct("id", 0.02).alias("ids"))


@query("SELECT coalesce(source, 'unknown') AS source, substr(md5(text), 1, 1) AS prefix, count(*) AS objects, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def prefix_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Objects and bytes by hashed prefix."""
    rows = table(spark, sf, "documents").where("text is not null")
    return rows.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), F.substring(F.md5("text"), 1, 1).alias("prefix")).agg(F.count("*").alias("objects"), F.sum(F.octet_length("text")).alias("bytes"))


@query(f"""WITH {LATEST} SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id,
't/' || substr(k, 1, 2) || '/' || substr(k, 3, 2) || '/' || replace(id, ':', '_') || '.webp' AS object_key FROM (SELECT id, sha1(unhex('{X.URL_NAMESPACE}') || encode(id)) AS h, md5(replace(id, ':', '_')) AS k FROM latest)""")
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Name-based identifiers and balanced object keys."""
    return latest_images(spark, sf).select("id", X.uuid5(F.col("id")).alias("point_id"), X.object_key(F.col("id")).alias("object_key"))


@query("SELECT count(*) AS n, count(*) FILTER (sha256(build || '|' || unit) = unit_hash) AS same FROM jobs")
def unit_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """How many units hash to what the queue holds."""
    same = X.unit_hash(F.col("build"), F.col("unit")) == F.col("unit_hash")
    return table(spark, sf, "jobs").agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


@query("SELECT id, CASE WHEN json_valid(unit) THEN unit ->> '$.source' END AS source, CASE WHEN json_valid(unit) THEN unit ->> '$.name' END AS name, CASE WHEN json_valid(unit) THEN unit ->> '$.topic' END AS topic, CASE WHEN json_valid(unit) THEN unit ->> '$.lic' END AS lic, json_valid(unit) AS valid FROM jobs")
def unit_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of each unit; a broken unit has none."""
    valid = F.try_parse_json("unit").isNotNull()
    field = lambda n: F.when(valid, F.get_json_object("unit", f"$.{n}")).alias(n)
    return table(spark, sf, "jobs").select("id", field("source"), field("name"), field("topic"), field("lic"), F.coalesce(valid, F.lit(False)).alias("valid"))


_VALID = "SELECT DISTINCT id FROM vectors WHERE id IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vec, lambda x: x <> 0)) > 0"


@query(f"WITH {LATEST}, v AS ({_VALID}) SELECT id, state FROM latest WHERE state IN ('stored', 'embedded') AND id NOT IN (SELECT id FROM v)")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Images that still lack a valid vector."""
    return latest_images(spark, sf).where(F.col("state").isin("stored", "embedded")).select("id", "state").join(table(spark, sf, "vectors").where(is_valid(F.col("vec"), SIZE)).select("id"), "id", "left_anti")


@query("SELECT DISTINCT id FROM vectors WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM images WHERE id IS NOT NULL)")
def vectors_without_image(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vectors").where("id is not null").select("id").distinct().join(table(spark, sf, "images").select("id"), "id", "left_anti")


@query(f"WITH {LATEST}, v AS (SELECT DISTINCT id FROM vectors WHERE id IS NOT NULL), i AS (SELECT id FROM latest) SELECT (SELECT count(*) FROM (SELECT id FROM i UNION SELECT id FROM v)) AS either, (SELECT count(*) FROM (SELECT id FROM i INTERSECT SELECT id FROM v)) AS both, (SELECT count(*) FROM (SELECT id FROM i EXCEPT SELECT id FROM v)) AS only_images, (SELECT count(*) FROM (SELECT id FROM v EXCEPT SELECT id FROM i)) AS only_vectors")
def id_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and differences of two id sets, in one pass over both."""
    mark = lambda t, a, b: table(spark, sf, t).where("id is not null").select("id", F.lit(a).alias("i"), F.lit(b).alias("v"))
    each = mark("images", 1, 0).unionAll(mark("vectors", 0, 1)).groupBy("id").agg(F.max("i").alias("i"), F.max("v").alias("v"))
    return each.agg(F.count("*").alias("either"), F.count_if((F.col("i") == 1) & (F.col("v") == 1)).alias("both"), F.count_if(F.col("v") == 0).alias("only_images"), F.count_if(F.col("i") == 0).alias("only_vectors"))


@query("WITH base AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0), batch AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0) SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM batch WHERE o_custkey NOT IN (SELECT o_custkey FROM base)) WHERE r = 1")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """First rows of the customers that a table doesn't hold yet."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.insert_ignore(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 <> 0"), "o_custkey", [F.col("o_orderkey")])


@query("SELECT id, state, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, state DESC) AS r FROM images WHERE id IS NOT NULL) WHERE r = 1")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The table after the later half of the crawls has replaced what it holds of the earlier half."""
    rows = table(spark, sf, "images").where("id is not null").select("id", "state", "fetched_at")
    middle = F.lit("2025-02-23 12:00:00").cast("timestamp_ntz")
    early = relational.first_per(rows.where(F.col("fetched_at") < middle), ["id"], [F.desc("fetched_at"), F.desc("state")])
    return relational.upsert(early, rows.where(F.col("fetched_at") >= middle), "id", [F.desc("fetched_at"), F.desc("state")])


@query("SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_place_last_value(spark: SparkSession, sf: str) -> DataFrame:
    return relational.first_place_last_value(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT count(*) FILTER (n > 1) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM (SELECT md5(text) AS h, count(*) AS n FROM documents WHERE length(trim(text)) > 0 GROUP BY 1)")
def exact_dups(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.exact_duplicates(table(spark, sf, "documents"), "text")


_STEM = f"lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '(?i){X.IMAGE_FILE}', ''), '(?i){X.SERIES_END}', ''), '[\\s\\p{{Z}}]+', ' ', 'g')))"


@query(f"WITH {LATEST}, s AS (SELECT {_STEM} AS stem, count(*) AS n FROM latest GROUP BY 1) SELECT stem, n FROM s WHERE n > 1 AND length(stem) > 8")
def title_series(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that differ only in a trailing number."""
    stems = latest_images(spark, sf).groupBy(X.series_stem(F.col("title")).alias("stem")).agg(F.count("*").alias("n"))
    return stems.where((F.col("n") > 1) & (F.length("stem") > 8))


@query("SELECT regexp_extract(topic, '(\\S+)$', 1) AS kind, count(*) AS topics, sum(hits)::BIGINT AS hits, round(100.0::DOUBLE * sum(hits) / (SELECT sum(hits) FROM topic_hits), 6) AS pct FROM topic_hits GROUP BY 1")
def topic_allocation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "topic_hits")
    kinds = rows.groupBy(F.regexp_extract("topic", r"(\S+)$", 1).alias("kind")).agg(F.count("*").alias("topics"), F.sum("hits").alias("hits"))
    return kinds.crossJoin(F.broadcast(rows.agg(F.sum("hits").alias("total")))).select("kind", "topics", "hits", F.round(F.try_divide(100.0 * F.col("hits"), F.col("total")), 6).alias("pct"))


@query("SELECT substr(md5(id), 1, 2) AS shard, count(*) AS rows, min(id) AS first_id, count(DISTINCT id) AS ids FROM images WHERE id IS NOT NULL GROUP BY 1")
def manifest_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per shard of the manifest."""
    return table(spark, sf, "images").where("id is not null").groupBy(F.substring(F.md5("id"), 1, 2).alias("shard")).agg(F.count("*").alias("rows"), F.min("id").alias("first_id"), F.count_distinct("id").alias("ids"))


_PHRASES = [("glacier", "mossy glacier"), ("market", "gilded market"), ("lynx", "lynx cave"), ("badger", "")]


@query(f"WITH {LATEST}, q AS (SELECT id, ' ' || trim(regexp_replace(translate(lower(coalesce(title, '')), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) || ' ' AS c FROM latest), p(term, allowed) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PHRASES)}) SELECT id, count(*) AS terms FROM q, p WHERE contains(c, ' ' || term || ' ') AND NOT (allowed <> '' AND contains(c, ' ' || allowed || ' ')) GROUP BY id")
def phrase_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that hold a whole-word term, unless a phrase that exempts it is there too. The terms are a small table of neutral words."""
    terms = F.broadcast(spark.createDataFrame(_PHRASES, "term string, allowed string"))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    rows = latest_images(spark, sf).select("id", spaced(X.canonical_query(F.col("title"))).alias("c"))
    exempt = (F.col("allowed") != "") & F.contains(F.col("c"), spaced(F.col("allowed")))
    return rows.join(terms, F.contains(F.col("c"), spaced(F.col("term"))) & ~exempt).groupBy("id").agg(F.count("*").alias("terms"))
