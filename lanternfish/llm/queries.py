"""Queries of the problems for training data, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import abuse, canonical_values, distinctive, lookalike, mixing, near_duplicates, neighbours, textstats, tokenise, vectorblocks
from lanternfish.session import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_values.license_ids(table(spark, sf, "images"), table(spark, sf, "license_list"))


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_values.unmatched(table(spark, sf, "images"), table(spark, sf, "license_list"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.pairs(neighbours.most_similar(table(spark, sf, "vectors")))


def p3_search(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy search of the neighbour graph for a twentieth of the ids."""
    return neighbours.searched(table(spark, sf, "vectors"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.same_looking_pairs(table(spark, sf, "images"), "id", "title")


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct title with the canonical form of its class."""
    return lookalike.canonical_values(table(spark, sf, "images"), "title")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf, "images"), table(spark, sf, "vectors"))


def p5_title_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.groups(*near_duplicates.similar_titles(table(spark, sf, "images")))


def p5_vector_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.groups(*near_duplicates.similar_vectors(table(spark, sf, "vectors")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.flagged(table(spark, sf, "images"), table(spark, sf, "safety_labels"))


def p6_scores(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.scores(table(spark, sf, "images"), table(spark, sf, "safety_labels")).withColumns({"score": F.round("score", 6), "cosine": F.round("cosine", 6)})


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates(table(spark, sf, "images"), table(spark, sf, "safety_labels"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.distinctive(table(spark, sf, "images"))


def p7_weights(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.weights(table(spark, sf, "images"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenise.document_ids(table(spark, sf, "documents"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mixing.mixed(cut(mixing.sized(table(spark, sf, "documents"), targets)), targets)


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    rows = cut(mixing.sized(table(spark, sf, "documents"), targets))
    return mixing.shares(rows, mixing.mixed(rows, targets), targets)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return textstats.not_prose(table(spark, sf, "documents"))


def p10_types(spark: SparkSession, sf: str) -> DataFrame:
    return textstats.text_types(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_unmatched, p3_found, p3_search, p4_found, p4_classes, p5_found, p5_title_groups, p5_vector_groups, p6_found, p6_scores, p6_rates, p7_found, p7_weights, p8_ids, p9_mix, p9_shares, p10_found, p10_types)
}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _shown(column: str) -> str:
    """The consistent form but for the composition of accents in SQL, from the same character tables."""
    hidden = r"'[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x00-\x08\x0E-\x1B\x7F]'"
    blanks = r"'[\s\p{Z}\x{1C}-\x{1F}\x{0B}\x{85}\x{2800}]+'"
    text = f"trim(regexp_replace(regexp_replace({column}, {hidden}, '', 'g'), {blanks}, ' ', 'g'))"
    text = f"translate({text}, {_literal(lookalike.SINGLES[0])}, {_literal(lookalike.SINGLES[1])})"
    for one, letters in lookalike.LIGATURES:
        text = f"replace({text}, {_literal(one)}, {_literal(letters)})"
    return text


def _form(column: str) -> str:
    """The consistent form in SQL."""
    return f"nfc_normalize({_shown(column)})"


# Words of titles as sets; every two sets that share a word are compared, by the number of words they share.
_SETS = rf"""one AS (SELECT id, min(title) AS title FROM images WHERE id IS NOT NULL AND title IS NOT NULL GROUP BY id),
plain AS (SELECT id, regexp_replace(lower(trim(regexp_replace({_form("title")}, '{near_duplicates.MARKUP}', ' ', 'g'))), '{near_duplicates.EXTENSION}', '') AS t FROM one),
sets AS (SELECT id, list_sort(list_distinct(regexp_extract_all(t, '[\p{{L}}\p{{Nd}}]+'))) AS words FROM plain), held AS (SELECT * FROM sets WHERE len(words) >= 8),
classes AS (SELECT words, min(id) AS class_id, count(*) AS copies FROM held GROUP BY words), terms AS (SELECT class_id AS c, len(words) AS n, unnest(words) AS word FROM classes),
linked AS (SELECT a.c AS a, b.c AS b FROM terms a JOIN terms b ON a.word = b.word AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9)"""
_COSINES = """valid AS (SELECT id, min(vec)::DOUBLE[] AS v FROM vectors WHERE id IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY id)"""
_NEAR = f"{_COSINES}, near AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS sim FROM valid a, valid b WHERE a.id <> b.id)"


_ONE_TITLE = "(SELECT id, min(title) AS title FROM images WHERE id IS NOT NULL AND title IS NOT NULL GROUP BY id)"
_TERMS = f"""one AS (SELECT id, min(title) AS title, min(tags) AS tags FROM images WHERE id IS NOT NULL GROUP BY id),
runs AS (SELECT id, regexp_extract_all(lower({_form("title")}), '\\p{{L}}{{5,}}') AS a, regexp_extract_all(lower({_form("tags")}), '\\p{{L}}{{5,}}') AS b FROM one),
terms AS (SELECT id, list_concat(coalesce(a, []), coalesce(b, [])) AS t FROM runs),
counts AS (SELECT id, len(t) AS record_terms, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM terms) GROUP BY ALL),
totals AS (SELECT term, sum(tf) AS n, count(*) AS df FROM counts GROUP BY term)"""

# Classes of equal direction, by the 16-bit codes of unit vectors.
_DIRECTIONS = f"""{_COSINES}, scaled AS (SELECT id, list_transform(v, lambda x: x / most) AS y FROM (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) AS most FROM valid)),
coded AS (SELECT id, list_transform(y, lambda x: round_even(x / norm * {vectorblocks.SCALE}, 0)) AS code FROM (SELECT id, y, sqrt(list_dot_product(y, y)) AS norm FROM scaled)),
directions AS (SELECT code, min(id) AS class_id, count(*) AS copies FROM coded GROUP BY code), alike AS (SELECT a.class_id AS a, count(*) AS links FROM directions a, directions b WHERE a.class_id <> b.class_id AND list_cosine_similarity(a.code, b.code) >= 0.95 GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "p3_found": f"WITH {_NEAR}, best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 5) DESC, other) AS r FROM near WHERE sim >= 0.85) SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM best WHERE r <= 10",
    "p4_classes": f"WITH f AS (SELECT title AS value, {_shown('title')} AS shown FROM (SELECT DISTINCT title FROM images WHERE title IS NOT NULL)) SELECT value, min(shown) OVER (PARTITION BY nfc_normalize(shown)) AS canonical FROM f",
    "p5_found": f"WITH {_SETS}, {_NEAR}, by_title AS (SELECT x.id AS x, y.id AS y FROM held x JOIN classes cx ON x.words = cx.words JOIN linked l ON l.a = cx.class_id JOIN classes cy ON cy.class_id = l.b JOIN held y ON y.words = cy.words UNION SELECT x.id, y.id FROM held x JOIN held y USING (words) WHERE x.id <> y.id) SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM (SELECT x, y FROM by_title UNION ALL SELECT id, other FROM near WHERE sim >= 0.95)",
    "p5_vector_groups": f"WITH {_DIRECTIONS} SELECT c.id, d.class_id, d.copies, coalesce(l.links, 0)::BIGINT AS links FROM coded c JOIN directions d USING (code) LEFT JOIN alike l ON l.a = d.class_id",
    "p5_title_groups": f"WITH {_SETS}, degree AS (SELECT a, count(*) AS links FROM linked GROUP BY a) SELECT h.id, c.class_id, c.copies, coalesce(d.links, 0)::BIGINT AS links FROM held h JOIN classes c USING (words) LEFT JOIN degree d ON d.a = c.class_id",
    "p4_found": f"WITH f AS (SELECT id, title, {_form('title')} AS form FROM {_ONE_TITLE}) SELECT a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.form = b.form AND a.id < b.id AND a.title <> b.title",
    "p7_found": f"WITH {_TERMS} SELECT id, term FROM counts JOIN totals USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 5",
    "p7_weights": f"WITH {_TERMS}, s AS (SELECT sum(pow(len(t), 0.75)) AS s FROM terms) SELECT id, term, tf, df, round(greatest(ln(tf * s / (n * pow(record_terms, 0.75))), 0.0), 6) AS ppmi FROM counts JOIN totals USING (term), s",
}
