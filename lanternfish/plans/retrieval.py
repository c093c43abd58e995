"""Queries on retrieval, vectors and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions.maths import dot, sigmoid
from lanternfish.operators import approximate, relational, retrieval, statistics, vectors
from lanternfish.plans.frames import CATALOGUE, LATEST, PROMPTS, SEARCHES, UNITS, WORDS, catalogue, latest_images, prompts, searches, unit_vectors
from lanternfish.plans.registry import query
from lanternfish.session import cut, table

GROUPS = ["unsafe", "clinical", "artistic", "safe"]
SCALE, BIAS = 10.0, -2.0


def _bm25(docs: str, asked: str = "searches") -> str:
    return f"""tok AS (SELECT doc_id AS id, {WORDS.format("text")} AS t FROM {docs}),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avg_len FROM tok),
post AS (SELECT id, len(t) AS len, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT qid, unnest(terms) AS term FROM {asked}),
bm AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM asked JOIN post USING (term) JOIN dfs USING (term), corpus GROUP BY qid, id)"""


def _top(source: str, k: int, per: str = "qid") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY score DESC, id) AS rank FROM {source} QUALIFY rank <= {k})"


def _dense(docs: str) -> str:
    return f"dn AS (SELECT qid, doc_id AS id, round(list_dot_product(qvec, vec), 6) AS score FROM searches, {docs} WHERE qvec IS NOT NULL AND vec IS NOT NULL)"


def _hybrid(docs: str, lists: tuple[str, ...] = ("bm", "dn"), k: int = 10) -> str:
    union = " UNION ALL ".join(f"SELECT qid, id, rank FROM {_top(x, 100)}" for x in lists)
    return f"fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ({union}) GROUP BY qid, id) SELECT qid, rank, id, score FROM {_top('fused', k)}"


@query(f"WITH {CATALOGUE}, {SEARCHES}, {_bm25('catalogue')}, {_dense('catalogue')}, {_hybrid('catalogue')}")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = cut(catalogue(spark, sf).select("doc_id", "text", "vec"))
    return retrieval.hybrid(docs, "doc_id", "text", "vec", searches(docs))


_KEPT = "marks AS (SELECT id AS image_id, avg(unsafe) AS score FROM safety_labels GROUP BY id), kept AS (SELECT c.* FROM catalogue c LEFT JOIN marks m USING (image_id) WHERE c.lang = 'en' AND NOT coalesce(m.score >= 0.5, false))"


@query(f"WITH {CATALOGUE}, {SEARCHES}, {_KEPT}, {_bm25('kept')}, {_dense('kept')}, {_hybrid('kept')}")
def hybrid_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Both branches over English documents whose image isn't known to be unsafe; images that nobody rated pass."""
    marks = table(spark, sf, "safety_labels").groupBy(F.col("id").alias("image_id")).agg(F.avg("unsafe").alias("score"))
    docs = cut(catalogue(spark, sf).join(marks, "image_id", "left").select("doc_id", "text", "vec", "lang", "score"))
    return retrieval.hybrid(docs, "doc_id", "text", "vec", searches(docs), keep=(F.col("lang") == "en") & retrieval.safe_enough(F.col("score"), 0.5))


@query(f"WITH {CATALOGUE}, {SEARCHES}, {_dense('catalogue')}, {_hybrid('catalogue', ('dn',))}")
def dense_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of hybrid search when the lexical branch gives nothing."""
    docs = cut(catalogue(spark, sf).select("doc_id", "text", "vec"))
    near = retrieval.dense(docs, "doc_id", "vec", searches(docs).where("qvec is not null"), 100)
    return retrieval.top(retrieval.fused([near]), 10).select("qid", "rank", "id", "score")


_ASKED = [("glacier", "mossy glacier"), ("lynx", "lynx cave")]


def _answers() -> str:
    """The search call in SQL: empty queries, refusals by neutral terms, one class, one row more than the page."""
    canon = "trim(regexp_replace(translate(lower(text), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
    terms = ", ".join(f"('{a}', '{b}')" for a, b in _ASKED)
    return f"""WITH {CATALOGUE}, {SEARCHES.replace("searches AS", "every_search AS").replace("SELECT doc_id AS qid,", f"SELECT doc_id AS qid, array_to_string({WORDS.format('text')}[1:8], ' ') AS phrase,")},
spaced AS (SELECT qid, ' ' || {canon.replace("lower(text)", "lower(phrase)")} || ' ' AS c FROM every_search), p(term, allowed) AS (VALUES {terms}), refused AS (SELECT DISTINCT qid FROM spaced, p WHERE contains(c, ' ' || term || ' ') AND NOT contains(c, ' ' || allowed || ' ')),
searches AS (SELECT qid, terms, qvec FROM every_search WHERE phrase <> '' AND qid NOT IN (SELECT qid FROM refused)), kept AS (SELECT * FROM catalogue WHERE (CASE doc_id % 3 WHEN 0 THEN 'public_domain' WHEN 1 THEN 'attribution' ELSE 'share_alike' END) IN ('attribution', 'share_alike')),
{_bm25("kept")}, {_dense("kept")}, {_hybrid("kept", k=11).replace("SELECT qid, rank, id, score FROM", "SELECT qid, rank, id, score, count(*) OVER (PARTITION BY qid) > 10 AS has_more, NULL::VARCHAR AS refusal FROM")} QUALIFY rank <= 10 UNION ALL SELECT qid, NULL, NULL, NULL, false, 'core' FROM refused"""


@query(_answers())
def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """The search call for all queries: empty and refused ones, a class filter, pages with a look at what follows."""
    docs = cut(catalogue(spark, sf).select("doc_id", "text", "vec", F.element_at(F.array(*[F.lit(c) for c in ("public_domain", "attribution", "share_alike")]), (F.col("doc_id") % 3 + 1).cast("int")).alias("license_class")))
    terms = spark.createDataFrame(_ASKED, "term string, allowed string")
    return retrieval.answered(docs, "doc_id", "text", "vec", searches(docs), "share_alike,attribution", terms)


@query(f"WITH {CATALOGUE}, {SEARCHES}, {_bm25('catalogue')}, {_dense('catalogue')}, {_hybrid('catalogue').replace('SELECT qid, rank, id, score FROM', 'now AS (SELECT qid, id FROM').strip()}), saved AS (SELECT qid, id FROM {_top('bm', 10)}) SELECT qid, count(*) FILTER (EXISTS (SELECT 1 FROM now WHERE now.qid = saved.qid AND now.id = saved.id))::INT AS shared, count(*)::INT AS of FROM saved GROUP BY qid".replace(") SELECT now AS (", "), now AS (").replace(") now AS", "), now AS"))
def saved_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How many of ten saved results each query still has: those of the lexical branch against the fused ones."""
    docs = cut(catalogue(spark, sf).select("doc_id", "text", "vec"))
    asked = cut(searches(docs))
    sparse = cut(retrieval.lexical(docs, "doc_id", "text", asked, 100))
    saved = sparse.where("rank <= 10").groupBy("qid").agg(F.collect_list("id").alias("ids"))
    return retrieval.saved_overlap(retrieval.hybrid(docs, "doc_id", "text", "vec", asked, sparse=sparse), saved)


@query(f"WITH {CATALOGUE}, {SEARCHES}, {_bm25('documents')} SELECT qid, rank, id, score FROM {_top('bm', 10)}")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    asked = searches(docs.withColumn("vec", F.lit(None).cast("array<double>")))
    return retrieval.lexical(docs, "doc_id", "text", asked, 10).select("qid", "rank", "id", "score")


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.term_statistics(retrieval.postings(table(spark, sf, "documents"), "doc_id", "text"))


def _embeddings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    return rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


_EXACT = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT id AS qid, v AS qv FROM e WHERE id % 20 = 0), s AS (SELECT qid, id, round(list_dot_product(qv, v), 6) AS score FROM q, e)"


@query(f"WITH {_EXACT} SELECT qid, rank, id, score FROM {_top('s', 10)}")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows, asked = _embeddings(spark, sf)
    return retrieval.dense(rows, "vec_id", "embedding", asked, 10).select("qid", "rank", "id", "score")


_SCALE = "sc AS (SELECT round(quantile_cont(abs(x), 0.9999), 9) AS scale FROM (SELECT unnest(v) AS x FROM e))"
_CODES = "c AS (SELECT id, list_transform(v, lambda x: greatest(-127, least(127, round_even(x / scale * 127, 0)))) AS v FROM e, sc)"
_INT8 = f"s8 AS (SELECT a.id AS qid, b.id AS id, round(list_dot_product(a.v, b.v), 6) AS score FROM c a, c b WHERE a.id % 20 = 0)"
_RECALL = "SELECT round((SELECT count(*) FROM (SELECT qid, id FROM {exact} INTERSECT SELECT qid, id FROM {found})) / (10.0::DOUBLE * count(DISTINCT qid)), 6) AS recall, count(DISTINCT qid) AS queries FROM s"


@query("WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT round(quantile_cont(abs(x), 0.9999), 9) AS scale FROM (SELECT unnest(v) AS x FROM e)")
def int8_scale(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.int8_scale(table(spark, sf, "embeddings"), "embedding")


def _int8_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return rows.crossJoin(F.broadcast(vectors.int8_scale(rows, "embedding"))).select("vec_id", "embedding", vectors.int8(F.col("embedding"), F.col("scale")).alias("code"))


@query(f"WITH {_EXACT}, {_SCALE}, {_CODES}, {_INT8} {_RECALL.format(exact=_top('s', 10), found=_top('s8', 10))}")
def recall_int8(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 10 of search over 8-bit codes."""
    rows, asked = _embeddings(spark, sf)
    codes = cut(_int8_codes(spark, sf))
    found = retrieval.dense(codes, "vec_id", "code", codes.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("code").alias("qvec")), 10)
    return vectors.overlap(found, retrieval.dense(rows, "vec_id", "embedding", asked, 10), 10)


@query(f"WITH {_EXACT}, {_SCALE}, {_CODES}, {_INT8}, two AS (SELECT s.* FROM {_top('s8', 20)} f JOIN s USING (qid, id)) {_RECALL.format(exact=_top('s', 10), found=_top('two', 10))}".replace("SELECT s.* FROM", "SELECT f.qid, f.id, s.score FROM"))
def recall_int8_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """Twice as many candidates by their codes, ranked again by the full vectors."""
    rows, asked = _embeddings(spark, sf)
    codes = cut(_int8_codes(spark, sf))
    found = retrieval.dense(codes, "vec_id", "code", codes.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("code").alias("qvec")), 20)
    full = found.select("qid", "id").join(rows.select(F.col("vec_id").alias("id"), "embedding"), "id").join(asked, "qid")
    again = retrieval.top(full.select("qid", "id", F.round(dot(F.col("qvec"), F.col("embedding")), 6).alias("score")), 10)
    return vectors.overlap(again, retrieval.dense(rows, "vec_id", "embedding", asked, 10), 10)


@query(f"WITH {_EXACT}, b AS (SELECT id, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END) AS v FROM e), sb AS (SELECT x.id AS qid, y.id AS id, list_dot_product(x.v, y.v) AS score FROM b x, b y WHERE x.id % 20 = 0), two AS (SELECT f.qid, f.id, s.score FROM {_top('sb', 40)} f JOIN s USING (qid, id)) {_RECALL.format(exact=_top('s', 10), found=_top('two', 10))}")
def recall_binary_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by the signs alone (64 less twice the Hamming distance), ranked again by the full vectors."""
    rows, asked = _embeddings(spark, sf)
    signs = cut(rows.select("vec_id", vectors.sign_bits(F.col("embedding")).alias("bits")))
    found = retrieval.nearest_bits(signs, "vec_id", "bits", signs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "bits"), 40)
    full = found.select("qid", "id").join(rows.select(F.col("vec_id").alias("id"), "embedding"), "id").join(asked, "qid")
    again = retrieval.top(full.select("qid", "id", F.round(dot(F.col("qvec"), F.col("embedding")), 6).alias("score")), 10)
    return vectors.overlap(again, retrieval.dense(rows, "vec_id", "embedding", asked, 10), 10)


@query()
def dense_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate dense search in cells; its recall is the next query."""
    rows, asked = _embeddings(spark, sf)
    return approximate.search(rows, "vec_id", "embedding", asked, 10, approximate.cells(rows, "vec_id", "embedding")).select("qid", "rank", "id", "score")


@query()
def recall_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 10 of search in cells."""
    rows, asked = _embeddings(spark, sf)
    return vectors.overlap(dense_cells(spark, sf), retrieval.dense(rows, "vec_id", "embedding", asked, 10), 10)


@query()
def recall_product_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 10 of search over codes of eight and of sixteen parts, ranked again by the full vectors."""
    rows, asked = _embeddings(spark, sf)
    exact, out = cut(retrieval.dense(rows, "vec_id", "embedding", asked, 10)), None
    for parts in (8, 16):
        found = approximate.search_codes(rows, "vec_id", "embedding", asked, 10, approximate.product_codes(rows, "vec_id", "embedding", parts))
        row = vectors.overlap(found, exact, 10).withColumn("parts", F.lit(parts))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {_EXACT}, {_SCALE}, {_CODES} SELECT id AS i, array_to_string(list_transform(v, lambda x: x::INT), ',') AS v FROM c")
def static_export(spark: SparkSession, sf: str) -> DataFrame:
    """The 8-bit codes of a static page's index, with short keys."""
    return _int8_codes(spark, sf).select(F.col("vec_id").alias("i"), F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("v"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.id AS qid, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM e a, e b WHERE a.id % 20 = 0 AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) <= 20)
SELECT qid, count(*) FILTER (sim >= 0.3) AS low, count(*) FILTER (sim >= 0.4) AS high FROM s GROUP BY qid""")
def near_dups_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Of the twenty nearest others of each probe, those above two thresholds."""
    rows = table(spark, sf, "embeddings")
    n = vectors.neighbour_counts(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", [0.3, 0.4])
    return n.select("qid", F.least("n_0", F.lit(20)).cast("long").alias("low"), F.least("n_1", F.lit(20)).cast("long").alias("high"))


@query("WITH e AS (SELECT vec_id, embedding AS v FROM embeddings) SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN v[i] > 0 THEN 1 ELSE 0 END))::INT AS positive FROM e")
def sign_bit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Set bits of each vector's 64-bit signature."""
    return table(spark, sf, "embeddings").select("vec_id", F.bit_count(vectors.sign_bits(F.col("embedding"))).alias("positive"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.id AS qid, count(*) FILTER (round(list_cosine_similarity(a.v, b.v), 6) >= 0.3) AS n3, count(*) FILTER (round(list_cosine_similarity(a.v, b.v), 6) >= 0.4) AS n4 FROM e a, e b WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY a.id)
SELECT round(100 * avg((n3 >= 1)::INT), 6) AS pct_any_low, round(100 * avg((n4 >= 1)::INT), 6) AS pct_any_high, round(100 * avg((n3 >= 5)::INT), 6) AS pct_five_low, round(avg(n3), 6) AS mean_low FROM s""")
def near_dup_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Share of probes with neighbours above two thresholds."""
    rows = table(spark, sf, "embeddings")
    n = vectors.neighbour_counts(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", [0.3, 0.4])
    pct = lambda c: F.round(100 * F.avg(c.cast("int")), 6)
    return n.agg(pct(F.col("n_0") >= 1).alias("pct_any_low"), pct(F.col("n_1") >= 1).alias("pct_any_high"), pct(F.col("n_0") >= 5).alias("pct_five_low"), F.round(F.avg("n_0"), 6).alias("mean_low"))


_SCORED = f"{UNITS}, {PROMPTS}, sc AS (SELECT id, grp, round(max(1 / (1 + exp(-greatest(-60.0, least(60.0, list_dot_product(vec, pvec) * {SCALE} + {BIAS}))))), 4) AS s FROM units, prompts GROUP BY id, grp), scores AS (SELECT id, {', '.join(f"max(s) FILTER (grp = '{g}') AS {g}" for g in GROUPS)} FROM sc GROUP BY id)"


def _prompted(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.prompt_scores(unit_vectors(spark, sf), "id", "vec", prompts(spark, sf), GROUPS, SCALE, BIAS)


@query(f"WITH {_SCORED} SELECT * FROM scores")
def safety_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Highest calibrated score of each group of prompts, for every image vector."""
    return _prompted(spark, sf)


@query(f"WITH {LATEST}, {_SCORED} SELECT l.id, l.state, s.unsafe, s.clinical FROM latest l LEFT JOIN scores s USING (id)")
def safety_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Scores merged into the image rows; rows without a vector keep null."""
    rows = latest_images(spark, sf).select("id", "state", F.lit(None).cast("double").alias("unsafe"), F.lit(None).cast("double").alias("clinical"))
    return relational.merge_payload(rows, _prompted(spark, sf).select("id", "unsafe", "clinical"), "id")


@query(f"WITH {LATEST}, {_SCORED} SELECT count(*) AS rows, count(*) FILTER (NOT coalesce(unsafe >= 0.5, false)) AS shown, count(*) FILTER (unsafe IS NULL) AS unscored, count(*) FILTER (unsafe >= 0.5) AS hidden FROM latest LEFT JOIN scores USING (id)")
def safety_filter_nullsafe(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_images(spark, sf).select("id").join(_prompted(spark, sf), "id", "left")
    ok = retrieval.safe_enough(F.col("unsafe"), 0.5)
    return rows.agg(F.count("*").alias("rows"), F.count_if(ok).alias("shown"), F.count_if(F.col("unsafe").isNull()).alias("unscored"), F.count_if(~ok).alias("hidden"))


@query(f"WITH {_SCORED}, m AS (SELECT round(unsafe - safe, 4) AS margin FROM scores) SELECT count(*) AS n, round(min(margin), 6) AS least, round(max(margin), 6) AS most, count(*) FILTER (margin > 0) AS above FROM m")
def prompt_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Margin between the highest unsafe and the highest safe score."""
    m = _prompted(spark, sf).select(F.round(F.col("unsafe") - F.col("safe"), 4).alias("m"))
    return m.agg(F.count("*").alias("n"), F.round(F.min("m"), 6).alias("least"), F.round(F.max("m"), 6).alias("most"), F.count_if(F.col("m") > 0).alias("above"))


_JUDGED = f"{_SCORED}, judged AS (SELECT id, (avg(unsafe) >= 0.5)::INT AS bad FROM safety_labels WHERE unsafe IS NOT NULL GROUP BY id), j AS (SELECT s.id, s.unsafe AS score, bad FROM judged JOIN scores s USING (id))"
_STEPS = [0.05, 0.1, 0.2, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8]


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    bad = table(spark, sf, "safety_labels").where("unsafe is not null").groupBy("id").agg((F.avg("unsafe") >= 0.5).cast("int").alias("bad"))
    return _prompted(spark, sf).select("id", F.col("unsafe").alias("score")).join(bad, "id")


@query(f"WITH {_JUDGED}, w AS (SELECT t.threshold, round(avg((score > threshold)::INT) FILTER (bad = 1), 6) AS caught, round(avg((score > threshold)::INT) FILTER (bad = 0), 6) AS lost FROM j, (SELECT unnest({_STEPS})::DOUBLE AS threshold) t GROUP BY t.threshold), o AS (SELECT *, round(caught - 3.0 * lost, 6) AS objective FROM w) SELECT *, threshold = first_value(threshold) OVER (ORDER BY objective DESC NULLS LAST, threshold) AS best FROM o")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.threshold_sweep(_judged(spark, sf), "score", "bad", _STEPS)


@query(f"WITH {_JUDGED}, r AS (SELECT bad, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM j) SELECT round((sum(rk) FILTER (bad = 1) - sum(bad) * (sum(bad) + 1) / 2.0) / (sum(bad) * sum(1 - bad)), 6)::DOUBLE AS auc, sum(bad)::BIGINT AS positives, sum(1 - bad)::BIGINT AS negatives FROM r")
def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.auc(_judged(spark, sf), "score", "bad")


@query(f"WITH {_JUDGED} SELECT min(score) FILTER (bad = 1) AS least_bad, max(score) FILTER (bad = 0) AS most_good, round(min(score) FILTER (bad = 1) - max(score) FILTER (bad = 0), 6) AS gap, round((min(score) FILTER (bad = 1) + max(score) FILTER (bad = 0)) / 2, 6) AS midpoint FROM j")
def gate_separation(spark: SparkSession, sf: str) -> DataFrame:
    """How far apart the two groups' scores lie, and the threshold between them."""
    low, high = F.min(F.when(F.col("bad") == 1, F.col("score"))), F.max(F.when(F.col("bad") == 0, F.col("score")))
    return _judged(spark, sf).agg(low.alias("least_bad"), high.alias("most_good"), F.round(low - high, 6).alias("gap"), F.round((low + high) / 2, 6).alias("midpoint"))


@query(f"WITH {_JUDGED} SELECT split_part(id, ':', 1) AS source, round(avg((score > 0.3)::INT), 6) AS loss_low, round(avg((score > 0.5)::INT), 6) AS loss_high FROM j WHERE bad = 0 GROUP BY 1")
def loss_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """Share of good rows lost at two thresholds, per source."""
    loss = lambda t: F.round(F.avg((F.col("score") > t).cast("int")), 6)
    return _judged(spark, sf).where("bad = 0").groupBy(F.substring_index("id", ":", 1).alias("source")).agg(loss(0.3).alias("loss_low"), loss(0.5).alias("loss_high"))


@query(f"WITH {LATEST}, {UNITS}, t AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS vec_id FROM topic_hits) SELECT l.id, round(1 / (1 + exp(-greatest(-60.0, least(60.0, list_dot_product(u.vec, e.embedding::DOUBLE[]) * {SCALE} + {BIAS})))), 4) AS relevance FROM latest l JOIN t USING (topic) JOIN embeddings e USING (vec_id) JOIN units u ON u.id = l.id")
def topic_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated score of each image against the vector of its own topic; the topics' vectors are one small table."""
    topics = relational.numbered(table(spark, sf, "topic_hits"), ["topic"], "vec_id").join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    rows = latest_images(spark, sf).select("id", "topic").join(topics.select("topic", "embedding"), "topic").join(unit_vectors(spark, sf), "id")
    return rows.select("id", F.round(sigmoid(dot(F.col("vec"), F.col("embedding")), SCALE, BIAS), 4).alias("relevance"))
