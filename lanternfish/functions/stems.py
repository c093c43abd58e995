"""Stems and stop words of English for the lexical index, after M. F. Porter, An algorithm for suffix stripping, Program 14 (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that carry no meaning of their own in a search.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# The endings of the paper's steps 2 to 4 and what becomes of them; in step 4 they vanish.
STEP_2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP_3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _kinds(word: str) -> str:
    """c for each consonant, v for each vowel; y after a consonant is a vowel."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """The number of times that consonants follow vowels."""
    return len(re.findall("v+c+", _kinds(stem)))


def _short(stem: str) -> bool:
    """Ends with consonant, vowel, consonant, the last none of w, x, y."""
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, endings: list[str] | dict[str, str]) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of an English word; words of other letters, and those of one or two, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    # Plurals.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and progressive forms.
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (end := _longest(word, ["ed", "ing"])) and "v" in _kinds(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-1:] == word[-2:-1] and _kinds(word)[-1:] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    # Compound endings become simple ones, and these go.
    for endings in (STEP_2, STEP_3):
        if (end := _longest(word, endings)) and _measure(word[: -len(end)]):
            word = word[: -len(end)] + endings[end]
    if end := _longest(word, STEP_4):
        base = word[: -len(end)]
        if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
            word = base
    # A last e and a doubled l.
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def _stems(x: pd.Series) -> pd.Series:
    return x.map(lambda ws: [stem(w) for w in ws], na_action="ignore")


def index_terms(words: Column, stemmed: bool = True, without: list[str] = STOP_WORDS) -> Column:
    """The words of a text as terms of the index: without stop words and, if ``stemmed``, as stems."""
    kept = F.filter(words, lambda w: ~w.isin(*without)) if without else words
    return _stems(kept) if stemmed else kept


def shared_terms(asked: Column, title: Column) -> Column:
    """The terms that a query and a title have in common, in order."""
    return F.array_sort(F.array_intersect(asked, title))
