"""Problem 5: near-duplicate records by vector or by the words of the title, with token-combination prefixes.

Words: every distinct word set is one representative, so copies cost one row. A set's words are ordered from the rarest to the most frequent;
two sets of Jaccard similarity t share at least k words among the first n - ceil(t n) + k of each. So either they share a
rare word there, or all the k are frequent: rare words are indexed one by one, frequent ones in combinations of k, and no pair is lost while no
list is long. Sets of more than ``long_words`` words would have too many combinations of k: theirs are all the words of a class of tokens. With more classes than two similar sets can differ in
words, some class holds the same words in both (``class_combinations``), so long sets meet by combinations too, and none is lost. Candidates are
verified exactly. Vectors: the tokens and tables are those of ``vectorblocks``, with exact verification.

Defined cases: null ids, invalid vectors and titles of fewer than ``least_words`` words are left out; an id counts once (of several
different vectors or titles, the least); ties do not arise, as every pair above the threshold is given; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm import neighbours, vectorblocks
from lanternfish.llm.lookalike import consistent_form
from lanternfish.session import cut

MARKUP = r"<[^<>]*>|&(?:[A-Za-z]+|#[0-9]+|#x[0-9A-Fa-f]+);"
# The final file extensions that are not words.
EXTENSION = r"\.(?:jpg|jpeg|png|tif|tiff|webp|gif)\s*$"


def title_words(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds ``to``, the sorted set of words of ``column``: runs of letters or digits of the consistent form, lower case, without markup and extension."""
    out = consistent_form(df, column, to)
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(to), MARKUP, " "))), EXTENSION, "")
    out = out.withColumn(to, F.array_sort(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))))
    return out.withColumn(to, F.filter(to, lambda x, i: (i == 0) | (x != F.get(to, i - 1))))  # linear, where array_distinct compares all strings


def _combinations(words: Column, k: int, picked: tuple[Column, ...] = ()) -> Column:
    """Hashes of all k-word combinations of a list, each in the list's order; a hash shared by chance only adds a candidate."""
    if k == 1:
        return F.transform(words, lambda x: F.xxhash64(*picked, x))
    return F.flatten(F.transform(words, lambda x, i: _combinations(F.slice(words, i + 2, F.size(words)), k - 1, (*picked, x))))


def class_combinations(rows: DataFrame, threshold: float) -> DataFrame:
    """(s, n, key) of sets (s, n, words): the words of each class of tokens, as one key.

    Sizes are cut to levels, each 1 / threshold times the one before, so similar sets are of one level or of neighbouring ones and meet in the group of the lower. Similar sets of
    a group differ in at most ``differ`` words, each of which changes one class. Of ``differ + spare`` classes at least ``spare`` are therefore equal in both. Empty classes give no keys,
    but a set with ``spare`` empty classes or more, which few have, gets one key for all of these.
    """
    step = 1 / threshold
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(step)) + 1e-9)
    rows = rows.select("s", "n", "words", F.explode(F.array(level, level - 1)).alias("g"))
    rows = rows.withColumn("differ", F.floor((step - 1) * F.pow(F.lit(step), F.col("g") + 1) + 1e-6)).withColumn("spare", 4 + F.floor(F.col("differ") / 5)).withColumn("classes", F.col("differ") + F.col("spare"))
    each = rows.select("s", "n", "g", "spare", "classes", F.explode("words").alias("word")).withColumn("class", F.pmod(F.xxhash64("g", "word"), F.col("classes")))
    filled = each.groupBy("s", "n", "g", "spare", "classes", "class").agg(F.bit_xor(F.xxhash64("word")).alias("x"))
    keys = filled.select("s", "n", F.xxhash64(F.lit("class"), "g", "class", "x").alias("key"))
    bare = filled.groupBy("s", "n", "g", "spare", "classes").agg(F.count("*").alias("held")).where(F.col("classes") - F.col("held") >= F.col("spare"))
    return keys.unionByName(bare.select("s", "n", F.xxhash64(F.lit("bare"), "g").alias("key")))


def similar_sets(sets: DataFrame, threshold: float = 0.8, k: int = 3, rare: int = 64, long_words: int = 40) -> DataFrame:
    """(a, b), a < b: pairs of the rows (s, words) of distinct word sets with a Jaccard similarity of at least ``threshold``."""
    n = F.size("words")
    least = F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")
    terms = sets.select("s", F.explode("words").alias("word"))
    often = terms.groupBy("word").agg(F.count("*").alias("df"))
    ordered = terms.join(often, "word").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    rows = cut(sets.join(ordered, "s").withColumns({"n": n, "least": least}))
    head = F.slice("w", 1, F.col("n") - F.col("least") + k)
    common = F.transform(F.filter(head, lambda x: x["df"] > rare), lambda x: x["word"])
    singles = F.transform(F.filter(head, lambda x: x["df"] <= rare), lambda x: F.xxhash64(x["word"]))
    short = rows.where(F.col("n") <= long_words).select("s", "n", F.explode(F.array_union(singles, _combinations(common, k))).alias("key"))
    far = class_combinations(rows.where(F.col("n") >= F.floor(long_words * F.lit(threshold)).cast("int")), threshold)
    index = short.unionByName(far)
    x, y = index.select("key", F.col("s").alias("a"), F.col("n").alias("na")), index.select("key", F.col("s").alias("b"), F.col("n").alias("nb"))
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & (F.col("a") < F.col("b"))
    candidates = x.join(y, "key").where(fits).select("a", "b").distinct()
    words = rows.select("s", "words")
    both = candidates.join(words.select(F.col("s").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("s").alias("b"), F.col("words").alias("wb")), "b")
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    # Strings are intersected one by one; long sets by their 64-bit hashes, through a hash set.
    shared = F.when(F.size("wa") <= 2 * long_words, F.size(F.array_intersect("wa", "wb"))).otherwise(F.size(F.array_intersect(hashed("wa"), hashed("wb"))))
    return both.where(shared >= (F.size("wa") + F.size("wb") - shared) * threshold - 1e-9).select("a", "b")


def similar_titles(df: DataFrame, key: str = "id", column: str = "title", threshold: float = 0.8, least_words: int = 8, **how: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, s), and links (a, b) between different word sets s."""
    one = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(F.min(column).alias("title"))
    one = one.where(F.length("title") >= 2 * least_words - 1)  # fewer characters can't hold so many words with something between them
    held = cut(title_words(one, "title", "words").select("id", "words"))  # written before it is filtered: a filter on the words would compute them twice
    held = held.where(F.size("words") >= least_words).withColumn("s", F.unhex(F.md5(F.array_join("words", " "))))
    sets = held.groupBy("s").agg(F.first("words").alias("words"))
    return held.select("id", "s"), similar_sets(cut(sets), threshold, **how)


def similar_vectors(df: DataFrame, key: str = "id", column: str = "vec", threshold: float = 0.95, size: int = 64, block_rows: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """Members (id, s), and links (a, b) between different classes s."""
    members, held, plan = neighbours.nodes(df, key, column, size, threshold, block_rows)
    found = vectorblocks.verified(vectorblocks.links(held, threshold, None, size, plan), held, threshold, size)
    return cut(members).withColumnRenamed("c", "s"), cut(found.select("a", "b"))


def id_pairs(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(id_a, id_b): the links as pairs of ids, with the pairs inside a class of copies, as the task's case list wants them."""
    several = members.groupBy("s").count().where("count > 1").select("s")
    copies = members.join(several, "s")
    inside = copies.select("s", F.col("id").alias("x")).join(copies.select("s", F.col("id").alias("y")), "s").where("x < y").select("x", "y")
    across = linked.join(members.select(F.col("s").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("s").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    return inside.unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a <> id_b")


def groups(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, class_id, copies, links): one row per id; class_id names its class of copies, links counts the other classes its class is linked to."""
    degree = linked.select(F.col("a").alias("s")).unionAll(linked.select(F.col("b").alias("s"))).groupBy("s").agg(F.count("*").alias("links"))
    classed = members.groupBy("s").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    out = members.join(classed.join(degree, "s", "left"), "s")
    return out.select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_duplicate_pairs(images: DataFrame, vectors: DataFrame, expand: Callable[[DataFrame, DataFrame], DataFrame] = id_pairs) -> DataFrame:
    """(id_a, id_b): pairs by vector or by title, each once."""
    by_vector, by_title = similar_vectors(vectors), similar_titles(images)
    return expand(*by_vector).unionByName(expand(*by_title)).distinct()
