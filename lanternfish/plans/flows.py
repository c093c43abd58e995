"""Queries on ordered events, planning and the job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternfish.functions import maths
from lanternfish.operators import jobqueue, planning, relational, sequences, statistics
from lanternfish.plans.registry import query
from lanternfish.session import table

NOW = 1_740_020_000.0
HOUR = lambda: F.date_trunc("hour", F.col("ts").cast("timestamp"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type".replace("quantile_cont(value", "quantile_cont(value::DOUBLE"))
def percentile_table(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles with linear interpolation, mean and maximum."""
    rows = table(spark, sf, "events")
    means = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    return statistics.percentiles(rows, ["event_type"], "value", {f"p{round(q * 100)}": q for q in (0.5, 0.75, 0.9, 0.95, 0.99)}).join(means, "event_type")


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, v[least(len(v) - 1, floor(len(v) * 0.95)::BIGINT) + 1] AS p95 FROM s")
def index_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.index_percentile(table(spark, sf, "events"), ["event_type"], "value", 0.95, "p95")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of shards: a user's events in order."""
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "value", "event_type", (F.col("value") >= 10).cast("int").alias("produced"))


@query("SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best FROM events")
def running_best(spark: SparkSession, sf: str) -> DataFrame:
    """High-water mark of each shard."""
    return sequences.running_best(_pages(spark, sf), "user_id", ["ts", "event_id"], HOUR(), "value").select("user_id", "event_id", "value", "best")


@query("SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best FROM events) WHERE value >= 0.3 * greatest(best, 1e-6)")
def relevance_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that reach a share of the best of their shard so far."""
    rows = sequences.running_best(_pages(spark, sf), "user_id", ["ts", "event_id"], HOUR(), "value")
    return sequences.above_floor(rows, "value", "best", 0.3).select("user_id", "event_id")


@query("""WITH b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best FROM events), f AS (SELECT *, (value < 0.1 * best)::INT AS bad FROM b),
i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f) SELECT user_id, event_id, (CASE WHEN bad = 1 THEN sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END)::BIGINT AS decayed FROM i""")
def decay_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive values under a tenth of the best so far; a recovery resets the count."""
    rows = sequences.running_best(_pages(spark, sf), "user_id", ["ts", "event_id"], HOUR(), "value")
    return sequences.streak(rows, "user_id", ["ts", "event_id"], HOUR(), F.col("value") < 0.1 * F.col("best"), "decayed").select("user_id", "event_id", "decayed")


@query("""WITH f AS (SELECT *, (value < 10)::INT AS bad FROM events), i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f), s AS (SELECT *, CASE WHEN bad = 1 THEN sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS barren FROM i),
k AS (SELECT *, coalesce(sum((barren >= 4)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM s) SELECT user_id, count(*) AS pages, max(barren)::BIGINT AS longest FROM k WHERE stops = 0 GROUP BY user_id""")
def barren_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each shard until four in a row produce nothing."""
    rows = sequences.streak(_pages(spark, sf), "user_id", ["ts", "event_id"], HOUR(), F.col("value") < 10, "barren")
    kept = sequences.until(rows, "user_id", ["ts", "event_id"], HOUR(), F.col("barren") >= 4)
    return kept.groupBy("user_id").agg(F.count("*").alias("pages"), F.max("barren").cast("long").alias("longest"))


@query("""WITH r AS (SELECT *, sum((value >= 10)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS kept FROM events), k AS (SELECT *, coalesce(sum((kept >= 20)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM r) SELECT user_id, event_id, kept::BIGINT AS kept FROM k WHERE stops = 0""")
def depth_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each shard up to the one that reaches the cap on its depth."""
    return sequences.depth_capped(_pages(spark, sf), "user_id", ["ts", "event_id"], HOUR(), "produced", 20).select("user_id", "event_id", "kept")


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type <> 'error') / 300.0::DOUBLE, 6) AS per_second FROM events GROUP BY 1")
def rate_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.rate_buckets(table(spark, sf, "events"), "ts", F.col("event_type") != "error")


@query("WITH b AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, count(*) / 300.0::DOUBLE AS rate, row_number() OVER (ORDER BY time_bucket(INTERVAL '5 minutes', ts)) AS i FROM events GROUP BY 1) SELECT round(avg(rate) FILTER (i > 2), 6) AS settled, round(1e6 / (avg(rate) FILTER (i > 2) * 20) / 3600, 6) AS hours FROM b")
def settled_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Mean rate without the first two buckets, and the hours that a million rows take twenty workers at it."""
    b = table(spark, sf, "events").groupBy(F.window("ts", "5 minutes")["start"].alias("bucket")).agg((F.count("*") / 300.0).alias("rate"))
    b = b.withColumn("i", F.row_number().over(W.orderBy("bucket"))).where("i > 2")
    return b.agg(F.round(F.avg("rate"), 6).alias("settled"), F.round(F.try_divide(F.lit(1e6), F.avg("rate") * 20) / 3600, 6).alias("hours"))


_SAMPLES = "n AS (SELECT user_id, epoch(ts)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of each user: seconds and the count so far."""
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    counted = sequences.running(table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], HOUR(), "sum", F.lit(1), "n")
    return counted.select("user_id", seconds.alias("t"), F.col("n").cast("long").alias("n"))


@query(f"WITH {_SAMPLES}, w AS (SELECT *, t - min(t) OVER p AS dt, n - min(n) OVER p AS dn FROM n WINDOW p AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW)) SELECT user_id, t, n, CASE WHEN dt > 20 AND dn > 0 THEN round(60.0::DOUBLE * dn / dt, 6) END AS per_minute FROM w".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def trailing_pace(spark: SparkSession, sf: str) -> DataFrame:
    """Pace over the trailing ten hours."""
    return sequences.trailing_pace(_samples(spark, sf), "user_id", "t", "n", 36_000)


@query(f"WITH {_SAMPLES}, l AS (SELECT user_id, max(n) AS done, 60.0::DOUBLE * (max(n) - 1) / (max(t) - min(t)) AS pace FROM n GROUP BY user_id) SELECT user_id, greatest(1000 - done, 0) AS remaining, round(least(100.0, 100.0::DOUBLE * done / 1000), 2) AS pct, CASE WHEN pace > 0 THEN round(greatest(1000 - done, 0) / pace, 2) END AS eta_minutes FROM l".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def progress_eta(spark: SparkSession, sf: str) -> DataFrame:
    last = _samples(spark, sf).groupBy("user_id").agg(F.max("n").alias("done"), F.try_divide(60.0 * (F.max("n") - 1), F.max("t") - F.min("t")).alias("pace"))
    return last.select("user_id", *[c.alias(n) for n, c in maths.progress(F.col("done"), F.lit(1000), F.col("pace")).items()])


@query(f"WITH RECURSIVE {_SAMPLES}, k AS (SELECT user_id, min(t) AS t FROM n GROUP BY user_id UNION ALL SELECT user_id, t FROM (SELECT k.user_id, (SELECT min(n.t) FROM n WHERE n.user_id = k.user_id AND n.t >= k.t + 3600) AS t FROM k) WHERE t IS NOT NULL) SELECT user_id, t FROM k".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def thinned_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples at least an hour apart, each measured from the last that was kept."""
    return sequences.thinned(_samples(spark, sf), "user_id", "t", 3600.0)


@query(f"WITH RECURSIVE {_SAMPLES}, k AS (SELECT user_id, min(t) AS t FROM n GROUP BY user_id UNION ALL SELECT user_id, t FROM (SELECT k.user_id, (SELECT min(n.t) FROM n WHERE n.user_id = k.user_id AND n.t >= k.t + 3600) AS t FROM k) WHERE t IS NOT NULL) SELECT user_id, t FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC) <= 5".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def sample_ring(spark: SparkSession, sf: str) -> DataFrame:
    """The last five of the samples that are an hour apart: a ring of a fixed size is the feature."""
    return sequences.thinned(_samples(spark, sf), "user_id", "t", 3600.0, most=5)


@query(f"WITH RECURSIVE {_SAMPLES}, k AS (SELECT user_id, min(t) AS t FROM n GROUP BY user_id UNION ALL SELECT user_id, t FROM (SELECT k.user_id, (SELECT min(n.t) FROM n WHERE n.user_id = k.user_id AND n.t > k.t + 7200) AS t FROM k) WHERE t IS NOT NULL), f AS (SELECT user_id, count(*) AS fills FROM k GROUP BY user_id) SELECT user_id, count(*) AS requests, count(*) - any_value(fills) AS hits FROM n JOIN f USING (user_id) GROUP BY user_id".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits and misses of a cache whose entries live two hours."""
    rows = sequences.cache_replay(_samples(spark, sf), "user_id", "t", 7200.0)
    return rows.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"))


@query("WITH j AS (SELECT worker, created_at AS a, updated_at AS b FROM jobs WHERE worker IS NOT NULL AND updated_at >= created_at), m AS (SELECT worker, t, sum(d) AS d FROM (SELECT worker, a AS t, 1 AS d FROM j UNION ALL SELECT worker, b, -1 FROM j) GROUP BY ALL), o AS (SELECT worker, sum(d) OVER (PARTITION BY worker ORDER BY t) AS n FROM m) SELECT worker, max(n)::BIGINT AS most FROM o GROUP BY worker")
def worker_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that a worker had open at once."""
    return sequences.most_at_once(table(spark, sf, "jobs").where("worker is not null and updated_at >= created_at"), "worker", "created_at", "updated_at", 3600.0)


@query("WITH p AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 96 LIMIT 49) SELECT o_orderkey, o_totalprice, true AS has_more FROM (SELECT * FROM p ORDER BY o_totalprice DESC, o_orderkey LIMIT 48)")
def pagination(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of 48, and whether a row follows it: paging is the feature here."""
    return relational.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 96, 48)


@query("SELECT p_name, p_partkey FROM (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name)")
def ordered_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Names in order of their first place."""
    return table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT user_id, count(*) AS fresh FROM (SELECT user_id, row_number() OVER (PARTITION BY props ORDER BY user_id, event_id) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def fresh_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Items of each query that no earlier query had."""
    first = table(spark, sf, "events").groupBy("props").agg(F.min(F.struct("user_id", "event_id")).alias("f"))
    return first.groupBy(F.col("f.user_id").alias("user_id")).agg(F.count("*").alias("fresh"))


@query("WITH s AS (SELECT '' AS lower UNION SELECT chr(48 + i::INT) FROM range(10) t(i) UNION SELECT chr(65 + i::INT) FROM range(26) t(i) UNION SELECT chr(65 + i::INT) || chr(97 + j::INT) FROM range(26) t(i), range(26) u(j)) SELECT lower, lead(lower) OVER (ORDER BY lower) AS upper FROM s")
def shard_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return planning.name_ranges(spark)


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_name, p_partkey) - 1) % 7)::INT AS worker FROM part")
def stride_assign(spark: SparkSession, sf: str) -> DataFrame:
    return relational.stride(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 7).select("p_partkey", "worker")


@query("SELECT chunk, count(*) AS n, min(l_orderkey) AS first_key FROM (SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 400 AS chunk FROM lineitem) GROUP BY chunk")
def chunked_units(spark: SparkSession, sf: str) -> DataFrame:
    """Rows cut to chunks of 400 in order, without a sort of all rows in one task."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    cutup = relational.chunks(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 400)
    return cutup.groupBy("chunk").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"))


_BANDS, _LICENCES = ["narrow", "wide"], ["by", "by-sa", "zero", "pd"]


def _units(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "topic_hits")
    licences, bands = (spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("lic", _LICENCES), ("band", _BANDS)))
    return planning.weighted_units(hits.select("topic"), hits, licences, bands)


_UNITS = f"units AS (SELECT topic, lic, band, CASE WHEN least(10000.0, greatest(hits, 0) / 8.0) = 0 THEN 1.0 ELSE least(10000.0, greatest(hits, 0) / 8.0) END::DOUBLE AS weight FROM topic_hits, (SELECT unnest({_LICENCES}) AS lic), (SELECT unnest({_BANDS}) AS band))"


@query(f"WITH {_UNITS} SELECT * FROM units")
def unit_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Topics by licences by bands, with the rows each may yield."""
    return _units(spark, sf)


@query("SELECT topic, unnest(range(1, least(30, ceil(hits / 100.0))::BIGINT + 1))::INT AS page FROM topic_hits WHERE hits > 0")
def page_units(spark: SparkSession, sf: str) -> DataFrame:
    return planning.page_units(table(spark, sf, "topic_hits"), "hits").select("topic", "page")


_PACKED = f"""WITH RECURSIVE {_UNITS}, o AS (SELECT *, row_number() OVER (ORDER BY weight DESC, topic, lic, band) AS n FROM units),
step AS (SELECT 0::BIGINT AS n, list_transform(range(40), lambda x: 0.0::DOUBLE) AS loads, NULL::BIGINT AS lane UNION ALL
SELECT o.n, list_transform(range(1, 41), lambda i: step.loads[i] + CASE WHEN i = list_position(step.loads, list_min(step.loads)) THEN o.weight ELSE 0.0 END), list_position(step.loads, list_min(step.loads)) - 1 FROM step JOIN o ON o.n = step.n + 1)"""


@query(f"{_PACKED} SELECT topic, lic, band, weight, lane::INT AS lane FROM step JOIN o USING (n)")
def lpt_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Units on forty lanes, longest first."""
    return planning.balanced(_units(spark, sf), ["topic", "lic", "band"], "weight", 40)


@query(f"WITH {_UNITS}, l AS (SELECT (row_number() OVER (ORDER BY topic, lic, band) - 1) % 40 AS lane, weight FROM units), s AS (SELECT lane, sum(weight) AS load FROM l GROUP BY lane) SELECT count(*) AS lanes, round(max(load), 6) AS max_load, round(avg(load), 6) AS mean_load, round(max(load) / avg(load), 6) AS max_over_mean FROM s")
def stride_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Imbalance of lanes when units are dealt in turn."""
    return statistics.spread(relational.stride(_units(spark, sf), ["topic", "lic", "band"], 40), "worker", "weight")


@query(f"{_PACKED}, s AS (SELECT lane, sum(weight) AS load FROM step JOIN o USING (n) GROUP BY lane) SELECT count(*) AS lanes, round(max(load), 6) AS max_load, round(avg(load), 6) AS mean_load, round(max(load) / avg(load), 6) AS max_over_mean FROM s")
def lane_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Imbalance of lanes after packing."""
    return statistics.spread(lpt_pack(spark, sf), "lane", "weight")


def _queue_events(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for p in {"signup": "seed", "view": "claim", "click": "progress", "purchase": "complete", "error": "fail"}.items() for x in p])
    return table(spark, sf, "events").select(F.col("user_id").alias("job"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("event_id").alias("seq"), F.element_at(kinds, F.col("event_type")).alias("kind"), (F.col("event_id") % 4).alias("worker"), F.col("value").alias("amount"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("cursor")).withColumn("at", F.col("us") / 1e6)


_REPLAY = """WITH RECURSIVE e AS (SELECT user_id AS job, epoch_us(ts)::DOUBLE / 1e6 AS moment, CASE event_type WHEN 'signup' THEN 'seed' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS kind, event_id % 4 AS worker, value AS amount, CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR END AS cursor,
row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
r AS (SELECT DISTINCT job, 0::BIGINT AS n, NULL::VARCHAR AS state, NULL::BIGINT AS worker, 0 AS attempts, 0.0::DOUBLE AS produced, 0.0::DOUBLE AS lease_until, NULL::VARCHAR AS cursor, 0 AS refused FROM e UNION ALL
SELECT job, n, CASE WHEN ok AND kind = 'seed' THEN coalesce(st, 'pending') WHEN ok AND kind = 'claim' THEN 'claimed' WHEN ok AND kind = 'complete' THEN 'done' WHEN ok AND kind = 'fail' THEN 'failed' ELSE st END,
CASE WHEN ok AND kind = 'claim' THEN w WHEN ok AND kind IN ('complete', 'fail') THEN NULL ELSE wk END, attempts + (ok AND kind = 'claim')::INT, produced + CASE WHEN ok AND kind = 'progress' THEN greatest(0.0, amount) ELSE 0.0 END,
CASE WHEN ok AND kind IN ('claim', 'progress') THEN moment + 86400.0 WHEN ok AND kind IN ('complete', 'fail') THEN 0.0 ELSE ls END, CASE WHEN ok AND kind = 'progress' THEN coalesce(cur, cursor) ELSE cursor END, refused + (NOT ok)::INT
FROM (SELECT *, CASE kind WHEN 'seed' THEN true WHEN 'claim' THEN coalesce(st = 'pending', false) ELSE coalesce(st = 'claimed' AND wk = w, false) END AS ok
FROM (SELECT r.job, e.n, e.kind, e.worker AS w, e.amount, e.moment, e.cursor AS cur, r.attempts, r.produced, r.cursor, r.refused, dead, CASE WHEN dead AND r.attempts >= 8 THEN 'failed' WHEN dead THEN 'pending' ELSE r.state END AS st, CASE WHEN dead AND r.attempts < 8 THEN NULL ELSE r.worker END AS wk, CASE WHEN dead AND r.attempts < 8 THEN 0.0 ELSE r.lease_until END AS ls
FROM (SELECT r.*, e.n AS en, coalesce(e.kind = 'claim' AND r.state = 'claimed' AND r.lease_until < e.moment, false) AS dead FROM r JOIN e ON e.job = r.job AND e.n = r.n + 1) r JOIN e ON e.job = r.job AND e.n = r.en)))
SELECT job, state, worker, attempts, produced, lease_until, cursor, refused FROM r QUALIFY n = max(n) OVER (PARTITION BY job)"""


@query(_REPLAY)
def queue_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Final state of each job after its events."""
    return jobqueue.replay(_queue_events(spark, sf), 86_400.0)


_EXPIRED = f"""x AS (SELECT * REPLACE (CASE WHEN dead AND attempts >= 4 THEN 'failed' WHEN dead THEN 'pending' ELSE state END AS state, CASE WHEN dead AND attempts >= 4 THEN 'lease expired too many times' ELSE reason END AS reason, CASE WHEN dead AND attempts < 4 THEN NULL ELSE worker END AS worker, CASE WHEN dead AND attempts < 4 THEN 0.0 ELSE lease_until END AS lease_until) FROM (SELECT *, state = 'claimed' AND lease_until < {NOW} AS dead FROM jobs))"""


@query(f"WITH {_EXPIRED} SELECT id, state, worker, lease_until, reason FROM x")
def queue_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs after the leases that have run out are taken back."""
    return jobqueue.expired(table(spark, sf, "jobs"), NOW, 4).select("id", "state", "worker", "lease_until", "reason")


@query(f"WITH {_EXPIRED} SELECT build, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'claimed') AS claimed, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, coalesce(sum(produced), 0)::BIGINT AS produced FROM x GROUP BY build")
def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    return jobqueue.counts(table(spark, sf, "jobs"), NOW, 4)


@query(f"WITH {_EXPIRED}, p AS (SELECT *, row_number() OVER (PARTITION BY build ORDER BY id) AS r FROM x WHERE state = 'pending') SELECT build, id, unit, coalesce(cursor, '{{}}') AS continue, attempts + 1 AS attempts, 'w0' AS worker, {NOW} + 900.0 AS lease_until FROM p WHERE r = 1".replace("900.0 AS", "900.0::DOUBLE AS"))
def queue_claim(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest pending job of each build."""
    return jobqueue.claimed(table(spark, sf, "jobs"), "w0", NOW, most_attempts=4)


@query("SELECT build, unit_hash, unit FROM jobs WHERE id % 3 <> 0")
def queue_seed(spark: SparkSession, sf: str) -> DataFrame:
    """Units that a seed inserts when the queue holds those of every third job: hashes known to it are left."""
    jobs = table(spark, sf, "jobs")
    return jobqueue.seeded(jobs.where("id % 3 = 0"), jobs.select("build", "unit_hash", "unit")).select("build", "unit_hash", "unit")


@query("SELECT id, least(pow(2, attempts), 30.0)::DOUBLE AS wait, CASE WHEN NOT (produced >= 50) AND attempts < 5 AND state = 'pending' THEN 75 ELSE 0 END AS code FROM jobs WHERE attempts IS NOT NULL AND produced IS NOT NULL")
def retry_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Capped exponential waits, and the exit code that asks for another run."""
    rows = table(spark, sf, "jobs").where("attempts is not null and produced is not null")
    code = maths.exit_code(F.col("attempts"), F.lit(5), (F.col("state") == "pending").cast("int"), F.col("produced") >= 50)
    return rows.select("id", maths.backoff(F.col("attempts"), 30.0).alias("wait"), code.alias("code"))
