"""Problem 4: one consistent form for texts that look the same but differ in their characters.

``consistent_form`` maps each text by itself, JVM-side. ``canonical_titles`` groups the mapped values under the
accent-sensitive Unicode collation, in which composed and combining accents are equal, picks the least member of each class as its
canonical form and joins it back; only distinct values are grouped, so a placeholder that fills a third of all rows costs one row.

Defined cases: null stays null and belongs to no class; a text of nothing but blanks or invisible characters becomes ''; texts of any
length are mapped whole; extra columns are untouched.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lanternfish.session import cut

# Letters that look like a Latin letter, by script. Each pair is the look-alike and the Latin letter it is read as.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҺH ԀD ԚQ ԜW ӀI аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϲc ϳj"
ARMENIAN = "ՕO ՍU օo սu հh ոn ցg զq յj"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎥI ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ"
OTHER = "ɡg ɩi ɑa ℓl ‐- ‑-"
# Characters that show nothing; blanks of any kind. Both as classes of Java patterns.
INVISIBLE = r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️\x{E0100}-\x{E01EF}\x00-\x08\x0E-\x1B\x7F]"
BLANKS = r"[\s\p{Z}\x1C-\x1F\x85⠀]+"
# Texts without any of these are as they should be: printable ASCII with single blanks inside.
UNLIKE = r"[^\x20-\x7E]|  |^ | $"
MARKS = [chr(c) for c in (*range(0x300, 0x313), 0x327, 0x328)]


def _singles() -> tuple[str, str]:
    """Source and target characters of translate: look-alikes, their accented forms, and characters that differ only in width."""
    pairs = {p[0]: p[1] for p in f"{CYRILLIC} {GREEK} {ARMENIAN} {CHEROKEE} {OTHER}".split()}
    for source, target in list(pairs.items()):
        for mark in MARKS:
            one, other = (unicodedata.normalize("NFC", x + mark) for x in (source, target))
            if len(one) == len(other) == 1:
                pairs[one] = other
    for c in (*range(0xFF01, 0xFFF0), 0x3000, *range(0x1D400, 0x1D800)):  # full and half widths; mathematical letters and digits
        wide = chr(c)
        narrow = unicodedata.normalize("NFKC", wide)
        if len(narrow) == 1 and narrow != wide and unicodedata.category(wide) != "Cn":
            pairs[wide] = pairs.get(narrow, narrow)
    return "".join(pairs), "".join(pairs.values())


def _ligatures() -> list[tuple[str, str]]:
    """Joined letters and numerals that are read as the letters they consist of."""
    return [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0xFB00, 0xFB07), *range(0x2160, 0x2180), 0x2026)]


SINGLES = _singles()
LIGATURES = _ligatures()


@F.pandas_udf(StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def mapped(text: Column) -> Column:
    """Everything but the composition of accents, in built-in functions. Plain texts, which are most, pass after one search."""
    return F.when(text.rlike(UNLIKE), _mapped(text)).otherwise(text)


def _mapped(text: Column) -> Column:
    text = F.regexp_replace(text, INVISIBLE, "")
    text = F.trim(F.regexp_replace(text, BLANKS, " "))
    text = F.translate(text, *SINGLES)
    joined = text
    for one, letters in LIGATURES:
        joined = F.replace(joined, F.lit(one), F.lit(letters))
    return F.when(text.rlike("[" + "".join(x for x, _ in LIGATURES) + "]"), joined).otherwise(text)


def consistent_form(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds ``to``, the consistent form of ``column``. Only texts with combining marks go through Python, for the composition."""
    out = df.withColumn(to, mapped(F.col(column)))
    return out.withColumn(to, F.coalesce(_composed(F.when(F.col(to).rlike(r"\p{M}"), F.col(to))), F.col(to)))


def canonical_values(df: DataFrame, column: str) -> DataFrame:
    """One row (value, canonical) for each distinct non-null value of ``column``; equal canonical means equal on screen."""
    distinct = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().withColumn("shown", mapped(F.col("value")))
    classes = distinct.groupBy(F.collate("shown", "UNICODE").alias("class")).agg(F.min("shown").alias("canonical"))
    return distinct.withColumn("class", F.collate("shown", "UNICODE")).join(classes, "class").select("value", "canonical")


def same_looking_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """(id_a, id_b): pairs of ids whose values are different strings with one canonical form, smaller id first, each once.

    A key counts once, with its least value. Classes of one string, which are nearly all, end before any pair is made. The different strings of a class are paired
    as strings, each pair once, and only then joined to the ids that hold them, so ids with equal strings never meet, however many there are.
    """
    one = cut(df.where(F.col(column).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(column).alias("value")))
    shown = cut(one.select("value").distinct().withColumn("shown", mapped(F.col("value"))))
    classes = shown.groupBy(F.collate("shown", "UNICODE").alias("class")).agg(F.min("shown").alias("canonical"), F.count("*").alias("n")).where("n > 1").select("class", "canonical")
    several = cut(shown.withColumn("class", F.collate("shown", "UNICODE")).join(classes, "class").select("canonical", "value"))
    a, b = several.select("canonical", F.col("value").alias("a")), several.select("canonical", F.col("value").alias("b"))
    strings = a.join(b, "canonical").where("a < b").select("a", "b")
    held = cut(one.join(several.select("value"), "value"))
    pairs = strings.join(held.select(F.col("value").alias("a"), F.col("key").alias("x")), "a").join(held.select(F.col("value").alias("b"), F.col("key").alias("y")), "b")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
