"""Problem 1: freely typed values mapped to the entries of a reference list.

Distinct values only. A value is normalised (consistent form, lower case, no accents) and cut to words. The words of the list, of its names and codes, and the synonyms of a
``Wording``, are held in an inverted index of character n-grams. Each distinct word of four letters or more of the values retrieves its candidates there, is scored by weighted
cosine and accepted above a threshold, a margin to every other meaning and a confirming edit distance; shorter words have to be equal. Words that mean nothing in the list are left out.

The terms of an entry are the words of its code, or of its name where it has no code; all words of a name together stand for its code. The terms of a value, and details such as
version and port, retrieve entries through an inverted index of terms, again by weighted cosine, threshold and margin: without a version, entries that differ only in it tie, and the margin rejects
them.

Any list can be mapped to: ``LICENCES`` holds what licences are called in other languages and which terms rule out others; another list needs no wording. Nothing is broadcast by force and
no size is assumed: values, words and the list meet in joins of distinct rows.

Defined cases: values that are null, blank or letter for letter a name of the list are left out; id 0 stands for no single entry; an id counts once (of
several different values, the least); ties are rejected by the margin; texts of any length are read whole; an empty table gives no rows, an empty list no entry.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.lookalike import mapped
from lanternfish.session import cut


@dataclass(frozen=True)
class Wording:
    """What a list's own columns can't tell of the values that mean its entries."""

    #: Other words for a word of the list.
    synonyms: Mapping[str, str] = field(default_factory=dict)
    #: Words of names that say nothing by themselves.
    ignored: str = ""
    #: Terms that rule out others in the same value, in this order.
    outranks: tuple[tuple[str, str], ...] = ()
    #: Terms that count only beside another.
    beside: Mapping[str, str] = field(default_factory=dict)
    #: Kinds of details with the column of the list and what they are in the words of a value.
    details: Mapping[str, tuple[str, Callable[[Column], Column]]] = field(default_factory=dict)
    #: A detail without which entries are compared as if they had none either.
    optional: str = ""


# The words that stand for a part of a licence, in the languages of the catalogues.
SYNONYMS = {
    "by": "attribution atribucion namensnennung attribuzione atribuicao paternite naamsvermelding",
    "sa": "sharealike alike compartirigual partage weitergabe condividi compartilhaigual gelijkdelen",
    "nc": "noncommercial commercial nocomercial comercial kommerziell commerciale naocomercial nietcommercieel",
    "nd": "noderivatives noderivs derivatives derivs derivadas sinderivadas sinobraderivada bearbeitungen bearbeitung modification modifications",
    "zero": "cco",
    "mark": "pdm",
    "pd": "gemeinfrei publicdomain publicdomainmark",
    "public": "publico publique publiek pub",
    "domain": "domaine dominio domein",
    "gfdl": "fdl documentation",
    "fal": "lal",
    "free": "libre",
    "ogl": "government",
}
# Ports of the licences, as codes and as names.
PORTS = "at au be br ca ch cl cn cz de dk es eu fi fr gr hr hu ie igo il in it jp kr mx nl no nz pl pt ro rs se sg th tw uk us za"
PORT_NAMES = {"germany": "de", "deutschland": "de", "allemagne": "de", "alemania": "de", "france": "fr", "frankreich": "fr", "francia": "fr", "austria": "at", "spain": "es", "italy": "it", "scotland": "scotland"}
WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)?"


def version(words: Column) -> Column:
    """The number with decimals, or the last whole number as one of ``.0``; different ones together are none that exists."""
    numbers = F.array_distinct(F.filter(words, lambda w: w.rlike(r"^[0-9]\.[0-9]+$")))
    whole = F.filter(words, lambda w: w.rlike(r"^[0-9]$"))
    return F.when(F.size(numbers) > 0, F.array_join(numbers, "|")).otherwise(F.concat(F.try_element_at(whole, F.lit(-1)), F.lit(".0")))


def port(words: Column) -> Column:
    """The code or name of a place right after the version."""
    names = F.create_map(*[F.lit(x) for p in ({x: x for x in PORTS.split()} | PORT_NAMES).items() for x in p])
    last = F.size(words) - F.array_position(F.reverse(words), F.coalesce(F.try_element_at(F.filter(words, lambda w: w.rlike("^[0-9]")), F.lit(-1)), F.lit(""))) + 1
    return F.when(version(words).isNotNull(), F.try_element_at(names, F.get(words, last.cast("int"))))


LICENCES = Wording(
    SYNONYMS, "cc license licence", (("zero", "by mark pd"), ("by", "mark"), ("mark", "pd")), {"sa": "by", "nc": "by", "nd": "by"}, {"v": ("version", version), "p": ("port", port)}, "v",
)


def _plain() -> tuple[str, str]:
    accented = [chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(accented), "".join(unicodedata.normalize("NFD", c)[0] for c in accented)


def normalised(value: Column) -> Column:
    """Lower case, no accents; joined abbreviations apart, and nought after cc as a word."""
    text = F.lower(F.regexp_replace(F.translate(mapped(value), *_plain()), r"\p{M}", ""))
    text = F.regexp_replace(text, r"&[a-z]+;|[_]", " ")
    text = F.regexp_replace(text, r"\bcc[ -]?0(?![.0-9])", " zero ")
    text = F.regexp_replace(text, r"\bpublic[ -]?domain\b", "public domain")
    return F.regexp_replace(text, r"(?<![a-z])(?:cc)?by(nc)?(nd)?(sa)?(?![a-z])", " by $1 $2 $3 ")


def _grams(word: Column) -> Column:
    """Distinct n-grams of two and three characters of the word with its borders."""
    edged = F.concat(F.lit("^"), word, F.lit("$"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(edged) - (n - 1), F.lit(1))), lambda i: F.substring(edged, i, F.lit(n)))
    return F.array_distinct(F.array_union(of(2), of(3)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(normalised(text), F.lit(WORD), F.lit(0))


def vocabulary(entries: DataFrame, columns: list[str], wording: Wording) -> DataFrame:
    """(entry, meaning): the words of the list, each of which means itself, and the synonyms."""
    spark = entries.sparkSession
    synonyms = spark.createDataFrame([(w, m) for m, ws in wording.synonyms.items() for w in ws.split()], "entry string, meaning string")
    own = entries.select(F.explode(F.concat(*[F.coalesce(_words(F.col(c)), F.array().cast("array<string>")) for c in columns])).alias("entry")).distinct()
    own = own.where(F.col("entry").rlike("^[a-z]") & ~F.col("entry").isin(*wording.ignored.split())).join(synonyms.select("entry"), "entry", "left_anti")
    return cut(own.select("entry", F.col("entry").alias("meaning")).unionByName(synonyms))


def word_meanings(words: DataFrame, known: DataFrame, threshold: float = 0.25, margin: float = 0.03) -> DataFrame:
    """(word, meaning) of the distinct words that mean a word of the vocabulary ``known``."""
    total = max(known.count(), 1)
    grams = known.select("entry", "meaning", F.explode(_grams(F.col("entry"))).alias("gram"))
    weight = grams.groupBy("gram").agg(F.log(1 + total / F.count("*")).alias("idf"))
    index = grams.join(weight, "gram")
    index = cut(index.join(index.groupBy("entry").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm")), "entry"))
    rare = F.log(F.lit(1.0 + total))  # the weight of a gram that no entry has
    long = words.where(F.length("word") >= 4).select("word", _grams(F.col("word")).alias("g"))
    hit = long.select("word", F.size("g").alias("n"), F.explode("g").alias("gram")).join(index, "gram")
    scored = hit.groupBy("word", "n", "entry", "meaning", "norm").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"), F.count("*").alias("shared"))
    scored = scored.withColumn("score", F.col("dot") / F.col("norm") / F.sqrt(F.col("dot") + (F.col("n") - F.col("shared")) * rare * rare))
    near = F.levenshtein("word", "entry") <= F.when(F.length("entry") >= 6, 2).otherwise(1)
    best = scored.where((F.col("score") >= threshold) & near & (F.length("entry") >= 4)).groupBy("word", "meaning").agg(F.max("score").alias("score"))
    ranked = best.groupBy("word").agg(F.max_by("meaning", F.struct("score", "meaning")).alias("meaning"), F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("s"))
    fuzzy = ranked.where(F.coalesce(F.get("s", F.lit(0)) - F.get("s", F.lit(1)) >= margin, F.lit(True))).select("word", "meaning")
    equal = words.join(known, F.col("word") == F.col("entry")).select("word", "meaning")
    return equal.unionByName(fuzzy.join(equal, "word", "left_anti"))


def _meant(df: DataFrame, key: str, words: str, meanings: DataFrame) -> DataFrame:
    """(key, meaning) of rows with a list of words."""
    return df.select(key, F.explode(words).alias("word")).join(meanings, "word").select(key, "meaning").distinct()


def entry_features(entries: DataFrame, key: str, name: str, code: str | None, known: DataFrame, wording: Wording) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the entries: their features (key, feature); the terms themselves (term); and rules (rule, need, word, terms): all words of a name stand for its code."""
    equal = known.where("entry = meaning").unionByName(known.where("entry <> meaning")).withColumnRenamed("entry", "word")
    named = _meant(entries.select(key, _words(F.col(name)).alias("w")), key, "w", equal)
    if code is None:
        terms, rules = named.withColumnRenamed("meaning", "term"), None
    else:
        terms = entries.select(key, F.explode(F.array_distinct(_words(F.col(code)))).alias("term"))
        both = named.groupBy(key).agg(F.sort_array(F.collect_set("meaning")).alias("words")).join(terms.groupBy(key).agg(F.sort_array(F.collect_set("term")).alias("terms")), key)
        rules = both.select("words", "terms").distinct().select(F.xxhash64("words", "terms").alias("rule"), F.size("words").alias("need"), F.explode("words").alias("meaning"), "terms")
    details = [entries.where(F.col(column).isNotNull()).select(key, F.concat(F.lit(f"{kind}:"), F.lower(column)).alias("feature")) for kind, (column, _) in wording.details.items()]
    out = terms.select(key, F.concat(F.lit("c:"), "term").alias("feature"))
    for d in details:
        out = out.unionByName(d)
    return cut(out), cut(terms.select("term").distinct()), cut(rules) if rules is not None else None


def value_features(values: DataFrame, terms: DataFrame, rules: DataFrame | None, known: DataFrame, wording: Wording) -> DataFrame:
    """(v, plain, feature) of each distinct value (v, value): its terms and details. v is a short key, so a long value isn't repeated with each of its words; ``plain`` says that it lacks
    the optional detail."""
    cutup = cut(values.select("v", _words(F.col("value")).alias("words")))
    distinct = cutup.select(F.explode("words").alias("word")).where(F.col("word").rlike("^[a-z]")).distinct()
    said = cut(_meant(cutup, "v", "words", word_meanings(distinct, known)))
    found = said.withColumnRenamed("meaning", "term").join(terms, "term").select("v", "term")
    if rules is not None:
        full = said.join(rules, "meaning").groupBy("v", "rule", "need").agg(F.count("*").alias("n"), F.first("terms").alias("terms")).where("n = need")
        found = found.unionByName(full.select("v", F.explode("terms").alias("term")))
    rows = cutup.join(found.groupBy("v").agg(F.collect_set("term").alias("t")), "v", "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    term = F.col("t")
    for t, other in wording.beside.items():
        term = F.when(F.array_contains("t", other), term).otherwise(F.array_remove(term, t))
    rows = rows.withColumn("t", term)
    for t, ruled_out in wording.outranks:
        rows = rows.withColumn("t", F.when(F.array_contains("t", t), F.array_except("t", F.array(*[F.lit(x) for x in ruled_out.split()]))).otherwise(F.col("t")))
    details = {kind: read(F.col("words")) for kind, (_, read) in wording.details.items()}
    features = F.array_compact(F.concat(F.transform("t", lambda x: F.concat(F.lit("c:"), x)), F.array(*[F.concat(F.lit(f"{k}:"), d) for k, d in details.items()]).cast("array<string>")))
    plain = details[wording.optional].isNull() if wording.optional else F.lit(False)
    return rows.select("v", plain.alias("plain"), F.explode(features).alias("feature"))


def matched(values: DataFrame, entries: DataFrame, key: str = "license_id", name: str = "name", code: str | None = "code", wording: Wording = LICENCES, threshold: float = 0.95, margin: float = 0.05) -> DataFrame:
    """(v, key) of the distinct values (v, value) that mean one entry."""
    known = vocabulary(entries, [c for c in (name, code) if c], wording)
    listed, terms, rules = entry_features(entries, key, name, code, known, wording)
    own = cut(value_features(values, terms, rules, known, wording))
    # Weights: what an entry is counts most, then its details.
    weight = F.when(F.col("feature").startswith("c:"), 2.0).otherwise(1.0)
    norm = own.groupBy("v").agg(F.sum(weight).alias("n"))
    hit = own.join(listed, "feature").groupBy("v", key, "plain").agg(F.sum(weight).alias("dot"))
    optional = F.max(F.when(F.col("feature").startswith(f"{wording.optional}:"), 1.0).otherwise(0.0)) if wording.optional else F.max(F.lit(0.0))
    scored = hit.join(norm, "v").join(listed.groupBy(key).agg(F.sum(weight).alias("m"), optional.alias("dated")), key)
    scored = scored.withColumn("score", F.col("dot") / F.sqrt(F.col("n") * (F.col("m") - F.when(F.col("plain"), F.col("dated")).otherwise(0.0))))
    best = scored.groupBy("v").agg(F.max_by(key, F.struct("score", key)).alias(key), F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("s"))
    sure = (F.get("s", F.lit(0)) >= threshold) & F.coalesce(F.get("s", F.lit(0)) - F.get("s", F.lit(1)) >= margin, F.lit(True))
    return best.where(sure).select("v", key)


def mapped_ids(df: DataFrame, entries: DataFrame, column: str, key: str = "id", entry: str = "license_id", name: str = "name", **how: object) -> DataFrame:
    """(key, entry): one row per key whose value is not null, not blank and no name of the list; null if it means no single entry."""
    one = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(F.min(column).alias("value"))
    one = cut(one.withColumn("v", F.unhex(F.md5("value"))))
    values = one.groupBy("v").agg(F.min("value").alias("value")).where(F.length(mapped(F.col("value"))) > 0).join(entries.select(F.col(name).alias("value")), "value", "left_anti")
    values = cut(values)
    found = matched(values, entries, entry, name, **how)
    return one.select("id", "v").join(values.select("v").join(found, "v", "left"), "v").select("id", entry)


def license_ids(images: DataFrame, entries: DataFrame, key: str = "id", column: str = "license", **how: object) -> DataFrame:
    """(id, license_id): one row per id whose value is not null, not blank and no name of the list; 0 if it means no single entry."""
    return mapped_ids(images, entries, column, key, **how).select("id", F.coalesce("license_id", F.lit(0)).cast("int").alias("license_id"))


def unmatched(images: DataFrame, entries: DataFrame, column: str = "license") -> DataFrame:
    """(value, n): the values that mean no single entry, with the ids that have them."""
    ids = license_ids(images, entries, "id", column).where("license_id = 0").select("id")
    one = images.where(F.col(column).isNotNull()).groupBy("id").agg(F.min(column).alias("value"))
    return one.join(ids, "id", "left_semi").groupBy("value").agg(F.count("*").alias("n"))
