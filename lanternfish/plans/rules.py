"""Queries on decisions, keyed pages, addresses and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternfish.functions import maths
from lanternfish.functions import text as X
from lanternfish.operators import jobqueue, normalise, planning, relational, sequences
from lanternfish.plans.corpus import _CLASS, _clean
from lanternfish.plans.flows import HOUR, NOW
from lanternfish.plans.frames import LATEST, latest_images
from lanternfish.plans.registry import query
from lanternfish.session import table

_CODE = "regexp_replace(coalesce({0}, ''), '^http ', '')"


@query("SELECT coalesce(fail_reason, '') AS reason, (coalesce(fail_reason = 'timeout', false) OR coalesce(try_cast(regexp_extract(fail_reason, '^http (\\d+)$', 1) AS INT) >= 500, false) OR coalesce(fail_reason = 'http 429', false)) AS transient, count(*) AS n FROM images GROUP BY ALL")
def transient_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Failures worth another try: broken transport, statuses of a busy server."""
    rows = table(spark, sf, "images").select("fail_reason")
    status = F.regexp_extract("fail_reason", r"^http (\d+)$", 1).try_cast("int")
    return rows.groupBy(F.coalesce("fail_reason", F.lit("")).alias("reason"), maths.transient_status(status, F.col("fail_reason") == "timeout").alias("transient")).agg(F.count("*").alias("n"))


_CODES = ["maxlag", "ratelimited", "readonly", "cirrussearch-too-busy-error", "internal_api_error_DBQueryError", "badtoken", "missingtitle", ""]


@query(f"WITH c AS (SELECT id, ({_CODES!r})[id % 9 + 1] AS code FROM jobs) SELECT code, coalesce(code IN ('maxlag', 'ratelimited', 'readonly', 'cirrussearch-too-busy-error') OR starts_with(code, 'internal_api_error'), false) AS transient, count(*) AS n FROM c GROUP BY ALL")
def transient_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of a wiki's interface that say its backend is busy; every ninth job has none."""
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("id") % 9).cast("int"))
    return table(spark, sf, "jobs").select(code.alias("code")).groupBy("code", maths.transient_code(F.col("code")).alias("transient")).agg(F.count("*").alias("n"))


@query("SELECT id, least(coalesce(try_cast(CASE WHEN id % 3 = 0 THEN (id % 400)::VARCHAR WHEN id % 3 = 1 THEN 'soon' END AS DOUBLE), pow(2, attempts + 1)), 120.0)::DOUBLE AS asked, [2, 4, 8, 16, 32, 60][attempts + 1] AS listed FROM jobs WHERE attempts IS NOT NULL")
def retry_delays(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds before a retry, by a header that is there, broken or missing, and by a fixed list."""
    rows = table(spark, sf, "jobs").where("attempts is not null")
    header = F.when(F.col("id") % 3 == 0, (F.col("id") % 400).cast("string")).when(F.col("id") % 3 == 1, "soon")
    return rows.select("id", maths.retry_delay(header, F.col("attempts")).alias("asked"), maths.listed_delay(F.col("attempts")).alias("listed"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN produced WHEN id % 3 = 0 THEN attempts ELSE produced + attempts END AS pending, CASE WHEN id % 2 <> 0 AND id % 3 <> 0 THEN 4000 ELSE 500 END AS every, (id % 5 > 0 AND produced >= id % 5 * 10) AS goal FROM jobs WHERE produced IS NOT NULL AND attempts IS NOT NULL")
def flush_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What a flush would write in each mode, how often it is due, and whether a goal is met; 0 is no goal."""
    rows = table(spark, sf, "jobs").where("produced is not null and attempts is not null")
    bare, single, goal = F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("id") % 5 * 10
    pending = maths.pending_count(bare, single, F.col("produced"), F.col("attempts"), F.col("produced") + F.col("attempts"))
    return rows.select("id", pending.alias("pending"), maths.flush_every(bare, single).alias("every"), maths.goal_met(F.col("produced"), goal).alias("goal"))


@query(f"WITH b AS (SELECT build, worker, sum(produced) AS done, count(*) FILTER (state = 'pending') AS queued, {NOW} - min(created_at) AS elapsed, count(*) FILTER (produced = 0) AS dry FROM jobs WHERE worker IS NOT NULL GROUP BY ALL) SELECT build, worker, CASE WHEN done >= 500 THEN 'target' WHEN done >= 400 THEN 'goal' WHEN elapsed >= 2e6 THEN 'time' WHEN dry >= 3 THEN 'dry' END AS reason FROM b")
def stop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why each worker of a build stops; null for one that goes on."""
    rows = table(spark, sf, "jobs").where("worker is not null").groupBy("build", "worker")
    sums = rows.agg(F.sum("produced").alias("done"), (F.lit(NOW) - F.min("created_at")).alias("elapsed"), F.count_if(F.col("produced") == 0).alias("dry"))
    reason = maths.stop_reason(F.col("done"), F.lit(500), F.col("done"), F.lit(400), F.col("elapsed"), F.lit(2e6), F.col("dry"))
    return sums.select("build", "worker", reason.alias("reason"))


_ITEMS = """items AS (SELECT split_part(id, ':', 1) AS source, CASE WHEN license ILIKE '%cc0%' THEN 'cc0' WHEN license ILIKE '%public domain%' THEN 'pdm' WHEN license ILIKE '%by%' THEN 'by' END AS licence, topic IS NULL AS mature, full_url AS url, source_url AS landing, split_part(id, ':', 2) AS key,
CASE WHEN width % 50 = 7 THEN 'wide' ELSE width::VARCHAR END AS width, height::VARCHAR AS height, id FROM latest),
r AS (SELECT *, try_cast(width AS DOUBLE) AS w, try_cast(height AS DOUBLE) AS h FROM items)"""
_SECURE = "regexp_matches(coalesce({0}, ''), '^https://[^/?#@:]+(:[0-9]+)?([/?#]|$)')"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    licence = F.when(F.lower("license").contains("cc0"), "cc0").when(F.lower("license").contains("public domain"), "pdm").when(F.lower("license").contains("by"), "by")
    source, key = F.substring_index("id", ":", 1), F.element_at(F.split("id", ":"), 2)
    width = F.when(F.col("width") % 50 == 7, "wide").otherwise(F.col("width").cast("string"))
    return latest_images(spark, sf).select(source.alias("source"), licence.alias("licence"), F.col("topic").isNull().alias("mature"), F.col("full_url").alias("url"), F.col("source_url").alias("landing"), key.alias("key"), width.alias("width"), F.col("height").cast("string").alias("height"), "id")


@query(f"""WITH {LATEST}, {_ITEMS} SELECT id, CASE WHEN source NOT IN ('commons', 'ov', 'openverse', 'met') THEN 'source' WHEN licence IS NULL THEN 'license' WHEN mature THEN 'sensitive_metadata'
WHEN NOT ({_SECURE.format("url")} AND {_SECURE.format("landing")} AND coalesce(key, '') <> '') THEN 'url_or_id' WHEN w IS NULL OR h IS NULL OR least(w, h) <= 0 THEN 'dimensions_unknown' WHEN least(w, h) < 480 OR greatest(w, h) < 640 THEN 'small' WHEN greatest(w, h) > 3 * least(w, h) THEN 'aspect' END AS reason FROM r""")
def item_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The first of seven rules that an item fails, in order."""
    c = F.col
    reason = normalise.rejected_item(c("source"), c("source"), c("licence"), normalise.flagged_item(c("mature"), F.lit(None).cast("array<string>")), c("url"), c("landing"), c("key"), c("width"), c("height"), ("commons", "ov", "openverse", "met"), ("cc0", "pdm", "by"))
    return _items(spark, sf).select("id", reason.alias("reason"))


@query(f"WITH {LATEST} SELECT id, split_part(id, ':', 1) || ':' || sha256(source_url) AS asset_key, full_url AS thumb FROM latest WHERE source_url IS NOT NULL")
def asset_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of assets by their landing pages; no file here has the provider's numbered names, which the tests cover."""
    key, thumb = X.derivative(F.col("full_url"), F.substring_index("id", ":", 1), F.col("source_url"), "flickr", "staticflickr.com")
    return latest_images(spark, sf).where("source_url is not null").select("id", key.alias("asset_key"), thumb.alias("thumb"))


_MEDIA = "lower(regexp_extract({0}, '^https?://([^/?#]*)', 1))"


@query(rf"""WITH {LATEST}, u AS (SELECT id, width, replace(thumb_url, '/t/', '/t/thumb/') AS thumb, full_url, regexp_extract(full_url, '^https?://[^/?#]*([^?#]*)', 1) AS op, regexp_extract(replace(thumb_url, '/t/', '/t/thumb/'), '^https?://[^/?#]*([^?#]*)', 1) AS tp FROM latest),
s AS (SELECT *, CASE WHEN {_MEDIA.format("thumb")} = 'commons.media-host.example' AND contains(tp, '/thumb/') AND NOT regexp_matches(lower(tp), '\.(gif|svg|svg\.png)$') AND regexp_matches(regexp_extract(tp, '([^/]*)$', 1), '[0-9]+px-') THEN 'swapped' ELSE '' END AS swapped,
CASE WHEN {_MEDIA.format("full_url")} = 'commons.media-host.example' AND starts_with(op, '/o/') AND NOT contains(op, '/thumb/') AND regexp_extract(op, '([^/]*)$', 1) <> '' AND NOT regexp_matches(lower(op), '\.(gif|svg|svg\.png)$') THEN 'https://commons.media-host.example/o/thumb/' || substr(op, 4) || '/3840px-' || regexp_extract(op, '([^/]*)$', 1) ELSE '' END AS built FROM u)
SELECT id, CASE WHEN coalesce(width, 0) > 3840 THEN coalesce(nullif(swapped, ''), built) ELSE '' END AS rendition FROM s""")
def wide_renditions(spark: SparkSession, sf: str) -> DataFrame:
    """Renditions of originals wider than 3840, on the one host that makes them, from the thumbnail's address or else the original's."""
    host = "commons.media-host.example"
    r = X.rendition(F.col("width"), F.replace(F.col("thumb_url"), F.lit("/t/"), F.lit("/t/thumb/")), F.col("full_url"), (host,), host, "/o/")
    return latest_images(spark, sf).select("id", r.alias("rendition"))


@query(f"WITH {LATEST}, c AS (SELECT *, CASE WHEN crc % 3 = 0 THEN 't/' || id WHEN crc % 3 = 1 THEN 'https://old-proxy.example/' || id ELSE '' END AS cdn FROM (SELECT *, length(id) AS crc FROM latest)) SELECT id, CASE WHEN cdn <> '' AND NOT starts_with(cdn, 'http') THEN 'https://img.example/' || cdn WHEN coalesce(thumb_url, '') <> '' THEN thumb_url ELSE cdn END AS thumb FROM c")
def shown_thumbnails(spark: SparkSession, sf: str) -> DataFrame:
    """Where each thumbnail is loaded from: own store, source, old proxy."""
    n = F.length("id") % 3
    cdn = F.when(n == 0, F.concat(F.lit("t/"), "id")).when(n == 1, F.concat(F.lit("https://old-proxy.example/"), "id")).otherwise("")
    return latest_images(spark, sf).select("id", X.shown_thumbnail(cdn, F.col("thumb_url"), "https://img.example/").alias("thumb"))


@query(f"WITH {LATEST} SELECT id, 'https://img.example/' || id AS public, 'https://proxy.example/?w=384&url=' || url_encode(id) AS proxy FROM latest")
def stored_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of objects, public and through a proxy."""
    return latest_images(spark, sf).select("id", X.stored_url(F.col("id"), "public", "https://img.example/").alias("public"), X.stored_url(F.col("id"), "proxy", "https://proxy.example/").alias("proxy"))


@query("SELECT origin FROM (SELECT full_url AS origin, min(id) AS first FROM images WHERE full_url IS NOT NULL AND id IS NOT NULL GROUP BY full_url ORDER BY first, origin LIMIT 50)")
def origins(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty different originals that proxied results name in their url parameter: stopping there is the feature."""
    proxied = F.concat(F.lit("https://proxy.example/?w=400&url="), F.url_encode("full_url"))
    rows = table(spark, sf, "images").where("full_url is not null and id is not null").select("id", F.url_decode(F.parse_url(proxied, F.lit("QUERY"), F.lit("url"))).alias("origin"))
    return rows.groupBy("origin").agg(F.min("id").alias("first")).orderBy("first", "origin").limit(50).select("origin")


@query("SELECT id, CASE WHEN json_valid(unit) THEN coalesce(unit ->> '$.start', json_object('topic', unit ->> '$.topic', 'lic', unit ->> '$.lic', 'band', unit ->> '$.band')::VARCHAR) ELSE json_object('topic', NULL, 'lic', NULL, 'band', NULL)::VARCHAR END AS label FROM jobs")
def shard_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "jobs").select("id", jobqueue.shard_label(F.col("unit")).alias("label"))


_FIELDS = ["source", "name", "topic", "lic", "band", "page", "start", "end"]


@query("SELECT id, coalesce(cursor, '{}') AS continue, attempts, " + ", ".join(f"CASE WHEN json_valid(unit) THEN unit ->> '$.{f}' END AS \"{f}\"" for f in _FIELDS) + " FROM jobs")
def flat_units(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs as workers get them: the fields of the unit beside id, cursor and attempts."""
    jobs = table(spark, sf, "jobs").select("id", "unit", F.coalesce("cursor", F.lit("{}")).alias("continue"), "attempts")
    return jobqueue.flattened(jobs, _FIELDS)


_WANTED = ["BUILDING", "MACHINERY"]


@query(f"WITH n AS (SELECT o_custkey AS c_custkey, count(*) AS links FROM orders GROUP BY 1), gone AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) SELECT c_custkey, links FROM customer JOIN n USING (c_custkey) WHERE links >= 10 AND c_mktsegment IN {tuple(_WANTED)} AND c_custkey NOT IN (SELECT o_custkey FROM gone) ORDER BY links DESC, c_custkey LIMIT 100")
def fame_list(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred most linked of the wanted kinds that are not gone: customers by their orders."""
    o = table(spark, sf, "orders")
    people = table(spark, sf, "customer").join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("links")), "c_custkey")
    kinds = spark.createDataFrame([(k,) for k in _WANTED], "c_mktsegment string")
    gone = o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return planning.famous(people, "links", 10, kinds, "c_mktsegment", gone, "c_custkey", 100).select("c_custkey", "links")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 256")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page of a scroll after a key: paging is the feature."""
    return relational.keyset_page(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 256)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a list of ids."""
    ids = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.looked_up(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ids, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ORDER BY o_orderkey LIMIT 60")
def missing_page(spark: SparkSession, sf: str) -> DataFrame:
    """New rows of a page, as many as the target still lacks."""
    page = table(spark, sf, "orders").where("o_orderkey % 4 = 1").select("o_orderkey", "o_custkey")
    held = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return relational.missing_page(page, held.where("o_custkey % 4 = 0"), held.where("o_custkey % 4 = 2"), "o_custkey", [F.col("o_orderkey")], 100, 40).select("o_orderkey")


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY md5('3|' || p_partkey::VARCHAR), p_partkey) - 1) % 7)::INT AS worker FROM part")
def shuffled_stride(spark: SparkSession, sf: str) -> DataFrame:
    """Units dealt in turn after a seeded shuffle."""
    rows = table(spark, sf, "part").select("p_partkey").withColumn("place", relational.shuffled(table(spark, sf, "part"), "p_partkey", 3)[0])
    return relational.stride(rows, ["place", "p_partkey"], 7).select("p_partkey", "worker")


@query("SELECT id FROM (SELECT DISTINCT id FROM images WHERE id IS NOT NULL) ORDER BY md5('0|' || id), id LIMIT 200")
def probe_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Two hundred ids, the same ones every time: a sampling operator."""
    return relational.probe(table(spark, sf, "images").where("id is not null").select("id").distinct(), "id", 0)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page FROM events WHERE event_type <> 'error') ORDER BY page, event_id LIMIT 1")
def next_unit(spark: SparkSession, sf: str) -> DataFrame:
    """The unit that is walked next, breadth first."""
    rows = table(spark, sf, "events").where("event_type <> 'error'").withColumn("page", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return planning.next_unit(rows, "page", "event_id").select("user_id", "event_id")


@query("WITH v AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page FROM events) SELECT user_id, page, row_number() OVER (ORDER BY page, event_id, user_id) - 1 AS turn, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY page), false) AS stuck FROM v")
def rotation(spark: SparkSession, sf: str) -> DataFrame:
    """The order in which a round-robin queue visits its jobs, and the visits that brought no new cursor."""
    visits = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("page"))
    return planning.rotation(visits, "page", "user_id", "event_type", "event_id").select("user_id", "page", "turn", "stuck")


@query("""WITH f AS (SELECT *, (value < 10)::INT AS bad FROM events), i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f), s AS (SELECT *, CASE WHEN bad = 1 THEN sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS barren FROM i)
SELECT user_id, max(barren)::BIGINT AS longest, count(*) FILTER (barren >= 10) AS tripped FROM s GROUP BY user_id""")
def breaker_trips(spark: SparkSession, sf: str) -> DataFrame:
    """How often each shard would trip the breaker for ten barren pages in a row."""
    rows = sequences.barren_break(table(spark, sf, "events"), "user_id", ["ts", "event_id"], HOUR(), F.col("value") < 10, fail=False)
    return rows.groupBy("user_id").agg(F.max("barren").cast("long").alias("longest"), F.count_if("tripped").alias("tripped"))


@query(f"WITH {LATEST}, c AS (SELECT {_CLASS.format('license')} AS license_class FROM latest) SELECT license_class, count(*) AS n FROM c WHERE license_class IN ('public_domain', 'share_alike') GROUP BY 1")
def class_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Images of any of the asked classes; an unknown class is an error before anything is read."""
    kept = normalise.in_classes(X.license_class(F.col("license")), "share_alike,public_domain,,")
    return latest_images(spark, sf).where(kept).groupBy(X.license_class(F.col("license")).alias("license_class")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) FILTER (strlen(text) <= 2000) AS kept, count(*) FILTER (strlen(text) > 2000) AS dropped FROM documents WHERE text IS NOT NULL GROUP BY source")
def byte_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Objects within a cap on their bytes."""
    ok = normalise.within_bytes(F.col("text"), 2_000)
    return table(spark, sf, "documents").where("text is not null").groupBy("source").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


_TERMS = {"water": ["weir", "ferry", "barge", "lock"], "stone": ["quarry", "belfry", "crypt"]}


@query(f"WITH {LATEST} SELECT id, " + ", ".join(f"regexp_matches(coalesce(title, ''), '(?i)\\b({'|'.join(ws)})\\b') AS {n}" for n, ws in _TERMS.items()) + " FROM latest")
def weak_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Weak labels of titles by whole words of two neutral lists, whatever their case."""
    return latest_images(spark, sf).select("id", *[X.mentions(F.coalesce("title", F.lit("")), ws).alias(n) for n, ws in _TERMS.items()])


@query(f"WITH {LATEST}, k AS (SELECT substr({_clean('creator')}, 1, 120) AS c, substr({_clean('title')}, 1, 300) AS t, id AS i, coalesce(width, 0) AS w FROM latest) SELECT i, t, c, w FROM k")
def short_metas(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata with short keys, as a static page carries it."""
    return normalise.short_meta(latest_images(spark, sf))


@query("WITH r AS (SELECT user_id, count(*) FILTER (event_type = 'view') / 720.0::DOUBLE AS a, count(*) FILTER (event_type = 'click') / 720.0::DOUBLE AS b FROM events GROUP BY user_id), c AS (SELECT *, least(a, b) AS overlapped, CASE WHEN a > 0 AND b > 0 THEN 1.0 / (1.0 / a + 1.0 / b) END AS serialised FROM r) SELECT user_id, round(overlapped, 9) AS overlapped, round(serialised, 9) AS serialised, (SELECT arg_max(user_id, (overlapped, -user_id)) FROM c) = user_id AS best FROM c")
def coupled_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of two coupled steps, overlapped and one after the other, and the setting with the best overlapped rate."""
    per_hour = lambda kind: F.count_if(F.col("event_type") == kind) / 720.0
    rows = table(spark, sf, "events").groupBy("user_id").agg(per_hour("view").alias("a"), per_hour("click").alias("b"))
    rows = rows.select("user_id", *[c.alias(n) for n, c in maths.coupled_rate(F.col("a"), F.col("b")).items()])
    best = rows.agg(F.max_by("user_id", F.struct("overlapped", -F.col("user_id"))).alias("top"))
    return rows.crossJoin(F.broadcast(best)).select("user_id", F.round("overlapped", 9).alias("overlapped"), F.round("serialised", 9).alias("serialised"), (F.col("user_id") == F.col("top")).alias("best"))


@query("WITH s AS (SELECT source, count(*) AS n, sum(strlen(text))::DOUBLE AS bytes FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source) SELECT source, round(4096 + (bytes - 4096) * 1e7 / n, 3) AS at_ten_million FROM s")
def projected_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each source at ten million rows, less what an empty store takes."""
    rows = table(spark, sf, "documents").where("text is not null and source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("double").alias("bytes"))
    return rows.select("source", F.round(maths.projected(F.lit(4096.0), F.col("bytes"), F.col("n"), 1e7), 3).alias("at_ten_million"))


@query("WITH g AS (SELECT topic, count(*) AS rows, min(doc_id) AS first FROM documents GROUP BY topic, CASE WHEN topic IS NULL THEN doc_id END) SELECT topic, rows, first, row_number() OVER (ORDER BY first) AS \"group\" FROM g")
def topic_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by topic, in order of the first of each; one without a topic is a group of its own."""
    return relational.grouped_in_order(table(spark, sf, "documents"), "topic", F.col("doc_id"), "doc_id").select("topic", "rows", "first", "group")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, last_value(CASE WHEN contains(line, ':') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM l) SELECT doc_id, md5(section) AS section, count(*) AS lines FROM h GROUP BY ALL""")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document by the last line above that has a colon."""
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    marked = sequences.carried_header(rows, "n", F.when(F.contains("line", F.lit(":")), F.col("line")), key="doc_id")
    return marked.groupBy("doc_id", F.md5("section").alias("section")).agg(F.count("*").alias("lines"))


@query("WITH v AS (SELECT doc_id, page, row_number() OVER (PARTITION BY page ORDER BY doc_id) - 1 AS place FROM (SELECT doc_id, doc_id // 20 + 1 AS page FROM documents)) SELECT doc_id, (page - 1) * 20 + place AS rank FROM v")
def page_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each item of a paged list from its page and its place there."""
    rows = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 20 + 1).cast("long").alias("page"))
    pages = rows.groupBy("page").agg(F.sort_array(F.collect_list("doc_id")).alias("items"))
    return planning.page_ranks(pages, "page", "items", 20).select(F.col("item").alias("doc_id"), "rank")


@query("SELECT id, CASE WHEN regexp_matches(coalesce(full_url, ''), '^https://[^/?#@:]+(:[0-9]+)?([/?#]|$)') AND state <> 'failed' THEN full_url ELSE '' END AS url, row_number() OVER (ORDER BY id, fetched_at, state, thumb_url, full_url) - 1 AS n FROM images".replace("ORDER BY id, fetched_at, state, thumb_url, full_url", "ORDER BY id") .replace("FROM images", "FROM (SELECT id, max(full_url) AS full_url, max(state) AS state FROM images WHERE id IS NOT NULL GROUP BY id)"))
def ordered_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a batch in the order of its input; one that failed is ''."""
    rows = table(spark, sf, "images").where("id is not null").groupBy("id").agg(F.max("full_url").alias("full_url"), F.max("state").alias("state"))
    tried = F.when(F.col("state") != "failed", X.secure_url(F.coalesce("full_url", F.lit(""))))
    return relational.numbered(rows.select("id", F.coalesce(tried, F.lit("")).alias("url")), ["id"])


@query("WITH s AS (SELECT id, avg(unsafe) AS score FROM safety_labels WHERE unsafe IS NOT NULL GROUP BY id) (SELECT id, round(score, 6) AS score, 'highest' AS side FROM s WHERE score >= 0.5 ORDER BY s.score DESC, id LIMIT 20) UNION ALL (SELECT id, round(score, 6), 'lowest' FROM s WHERE score < 0.5 ORDER BY s.score, id LIMIT 20)")
def score_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """The highest scores above a threshold and the lowest below it: two short reports."""
    rows = table(spark, sf, "safety_labels").where("unsafe is not null").groupBy("id").agg(F.avg("unsafe").alias("score"))
    high = rows.where("score >= 0.5").orderBy(F.desc("score"), "id").limit(20).withColumn("side", F.lit("highest"))
    low = rows.where("score < 0.5").orderBy("score", "id").limit(20).withColumn("side", F.lit("lowest"))
    return high.unionByName(low).select("id", F.round("score", 6).alias("score"), "side")
