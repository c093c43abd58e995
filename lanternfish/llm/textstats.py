"""Problem 10: statistics of each text, and from them whether it is prose or a list, table or junk.

Statistics are computed JVM-side, line by line, over whole texts. Thresholds on them are noisy labelling functions: each votes for a type, for
anything but prose, or abstains. How far each can be trusted is learned from their agreements alone, by expectation-maximization over the counts of
vote patterns (at most the product of the functions' votes, whatever the corpus), and the posterior of each type is a plain column expression. Texts whose
lines or words nearly all repeat are a type of their own there, as their words read like prose; they are reported as junk.

Defined cases: null, empty and blank texts have statistics of 0, no posterior and the type 'empty'; repeated texts are rated alike;
documents are rows, so equal keys stay apart as far as the texts differ; lines and texts of any length count whole; extra columns are dropped but for those
asked for; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.session import cut

# Function words of the four languages of the catalogue.
COMMON = {
    "en": "the and of to in is was were that it for on with as at by from this be are which but not have had has an or you we they there been could may more than when where out their its who will would if both into near seen",
    "fr": "le la les un une des du de et est que qui dans en ce cette il elle on ne pas pour par sur au aux avec son ses mais ou plus nous vous se sont ont été avant car",
    "de": "der die das den dem des ein eine einen einem einer und ist war wurde im zu von mit auf für nicht auch an aus wie als bei sich wird noch nach vor dass es wir er hat am um aber nur wer kaum diese dieser",
    "es": "el los las uno una del y que es se no por con para su al lo como pero fue más este esta entre sin sobre también son cuando muy había",
}
COMMON_WORDS = sorted({w for words in COMMON.values() for w in words.split() if len(w) > 1})
# Signs that are typed for letters; any other sign inside a word may stand for a vowel.
TYPED, LETTERS = "@30!1$5", "aeoilss"
VOWEL_OR_SIGN = r"[^\p{L}\p{N}\s|.,;:'’\"()/-]|[aeiouàáâèéêíóúûüöä]"
SKELETONS = sorted({re.sub("[aeiouàáâèéêíóúûüöä]", "¿", w) for w in COMMON_WORDS if len(w) > 2 or w[0] not in "aeiou"} - {"¿¿"})
UNPLAIN = r"[^|.,;:'’\"()/_-]"
DISGUISED = r"\p{L}[^\p{L}\s|.,;:'’\"()/_-]+\p{L}"
WORD = r"[\p{L}\p{N}@!#%&*§¶[\p{S}&&[^|]]]*[\p{L}\p{N}][\p{L}\p{N}@!#%&*§¶[\p{S}&&[^|]]]*"


def _trie(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings, so a place in a text is left after few comparisons."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    branches = []
    for head, tails in sorted(heads.items()):
        longer = [t for t in tails if t]
        branches.append(re.escape(head) + (_trie(longer) + ("?" if "" in tails else "") if longer else ""))
    return "(?:" + "|".join(branches) + ")"


ANY_COMMON = r"(?<![\p{L}\p{N}])" + _trie(COMMON_WORDS) + r"(?![\p{L}\p{N}])"
ANY_SKELETON = r"(?<![\p{L}\p{N}¿])" + _trie(SKELETONS) + r"(?![\p{L}\p{N}¿])"
BLOCK = r"(?i)</?(?:p|tr|li|br|div|h[1-6]|table|ul|ol|dl|dt|dd)\b[^<>]*>|\r\n?"
MARKUP = r"<[^<>]*>|&(?:[A-Za-z]+|#\d+);"
ITEM = r"^(?:[-*•–—+>]|\d+[.)]|\[[ xX]?\]|#\w|[a-z][.)])\s*"
CELLS = r"\|.*\||\t|\S {3,}\S|,[^\s,][^,]*,[^\s,]|^\s*[\w ]{1,24}\s*[:=]\s*\S|\d{4}-\d\d-\d\dT"
ENDS, CLOSING = (".", "!", "?", "…"), "\"'”’)»"


#: Characters besides letters and digits that count as parts of words; most lines have none and are cut to words by a simpler pattern.
MARKED = r"[@!#%&*§¶[\p{S}&&[^|]]]"
RUN = r"[\p{L}\p{N}]+"
#: What has to be replaced for runs of white space to be single blanks.
UNEVEN = r"[\x09-\x0D\x1C-\x1F\x85]|[\p{Z}&&[^ ]]|  |^ | $"


def _lines(df: DataFrame, key: str, column: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per non-empty line of each text, blocks of markup on lines of their own."""
    rows = df.select(F.col(key), *keep, F.monotonically_increasing_id().alias("row"), F.col(column).alias("text"))
    rows = rows.withColumn("whole", F.split(F.when(F.contains("text", F.lit("<")) | F.contains("text", F.lit("\r")), F.regexp_replace("text", BLOCK, "\n")).otherwise(F.col("text")), "\n"))
    once = F.array_distinct(F.transform(F.filter("whole", lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))  # numbers go through a hash set, strings would be compared one by one
    rows = rows.select(key, *keep, "row", F.coalesce(F.length("text"), F.lit(0)).alias("raw"), F.size(once).alias("different"), "whole")  # before the rows become lines
    rows = rows.select(key, *keep, "row", "raw", "different", F.explode_outer("whole").alias("line"))
    bare = F.when(F.contains("line", F.lit("<")) | F.contains("line", F.lit("&")), F.regexp_replace("line", MARKUP, " ")).otherwise(F.col("line"))
    rows = rows.withColumn("bare", bare)
    return rows.withColumn("shown", F.when(F.col("bare").rlike(UNEVEN), F.trim(F.regexp_replace("bare", r"(?U)\s+", " "))).otherwise(F.col("bare"))).drop("bare")


def statistics(df: DataFrame, key: str = "doc_id", column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: counts and shares of its words, symbols and lines. The columns of ``keep`` are handed through."""
    lines = _lines(df, key, column, keep)
    # What is neither letter nor blank is little, and tells of digits, symbols and disguised words without another search of the line.
    lines = lines.withColumns({"low": F.lower("shown"), "signs": F.regexp_replace("shown", r"[\p{L}\p{M}\s]+", "")}).withColumn("marked", F.col("signs").rlike(MARKED))
    lines = lines.withColumn("words", F.when(F.col("marked"), F.regexp_extract_all("low", F.lit(WORD), F.lit(0))).otherwise(F.regexp_extract_all("low", F.lit(RUN), F.lit(0))))
    typed = F.regexp_count(F.translate("low", TYPED, LETTERS), F.lit(ANY_COMMON))
    masked = F.regexp_count(F.regexp_replace("low", VOWEL_OR_SIGN, "¿"), F.lit(ANY_SKELETON))
    common = F.when(F.col("marked"), F.regexp_count("low", F.lit(ANY_COMMON))).otherwise(F.size(F.filter("words", lambda x: x.isin(*COMMON_WORDS))))
    distinct = F.size(F.array_distinct(F.transform("words", lambda x: F.xxhash64(x))))
    letters = F.when(F.col("marked"), F.length(F.regexp_replace("low", r"[^\p{L}\p{N}@!#%&*§¶[\p{S}&&[^|]]]+", ""))).otherwise(F.length(F.array_join("words", "")))
    lines = lines.withColumns({"w": F.greatest(F.size("words"), F.lit(0)), "common": common})
    lines = lines.select(
        key, *keep, "row", "raw", "different", "line", "shown", F.length("shown").alias("n"), "w", F.when(F.col("signs").rlike(UNPLAIN) & F.col("low").rlike(DISGUISED), F.greatest("common", typed, masked)).otherwise(F.col("common")).alias("c"),
        F.when(F.col("w") >= 30, distinct).otherwise(F.col("w")).alias("d"), letters.alias("wl"),
        F.length("signs").alias("signs"), F.length(F.regexp_replace("signs", r"[^\p{Nd}]+", "")).alias("digits"),
    )
    looped = (F.col("w") >= 30) & (F.col("d") < F.least(2 * F.sqrt("w"), F.lit(150)))
    lines = lines.withColumns({"looped": looped, "prose": (F.col("w") > 0) & (F.col("c") >= F.col("w") * 0.2) & ~looped, "entry": F.substring(F.ltrim("line", F.lit(" \t\v\f\r")), 1, 64).rlike(ITEM)})
    kind = F.when(F.col("prose"), "prose").when(F.col("line").rlike(CELLS), "table").when(F.col("entry") | (F.col("w") <= 6), "list")
    lines = lines.withColumns({"kind": kind, "ended": F.right(F.rtrim("shown", F.lit(CLOSING)), F.lit(1)).isin(*ENDS)})
    n = lambda x, when=None: F.sum(F.when(when, F.col(x)).otherwise(0) if when is not None else F.col(x)).cast("double")
    of = lambda k: n("n", F.col("kind") == k).alias(f"{k}_chars")
    sums = lines.groupBy("row", key, *keep, "raw", "different").agg(
        n("n").alias("shown"), n("w").alias("n_words"), n("wl").alias("wl"), n("c").alias("common"), n("signs").alias("signs"), n("digits").alias("digits"), n("n", F.col("looped")).alias("looped_chars"),
        F.count_if(F.col("n") > 0).alias("n_lines"), F.count_if((F.col("n") > 0) & F.col("ended")).alias("ended"), of("prose"), of("table"), of("list"),
        n("n", F.col("entry")).alias("item_chars"), n("n", F.col("w") >= 8).alias("long_chars"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return sums.select(
        key, *keep, F.col("raw").cast("long").alias("n_chars"), F.col("n_words").cast("long").alias("n_words"), F.col("n_lines").cast("long").alias("n_lines"),
        share("wl", "n_words").alias("mean_word_length"), share("signs", "shown").alias("symbol_ratio"), share("digits", "shown").alias("digit_ratio"),
        share("ended", "n_lines").alias("ended_share"), share("common", "n_words").alias("common_share"), share("prose_chars", "shown").alias("prose_share"),
        share("table_chars", "shown").alias("table_share"), share("list_chars", "shown").alias("list_share"), share("item_chars", "shown").alias("item_share"), share("long_chars", "shown").alias("long_line_share"),
        share("shown", "raw").alias("shown_share"), share("different", "n_lines").alias("different_share"), share("looped_chars", "shown").alias("looped_share"),
    )


TYPES = ("prose", "list", "table", "junk", "repeated")
#: What a vote speaks for before anything is learned; each function has its own likelihoods afterwards.
SPEAKS = {"prose": {"prose": 1.0}, "list": {"list": 3.0}, "table": {"table": 3.0}, "junk": {"junk": 3.0}, "other": {"list": 0.6, "table": 0.6, "junk": 0.6}, "repeated": {"repeated": 30.0}}
#: The greatest rate at which texts of another type are taken for repeats, and repeats for another type.
UNHEARD = 1e-6
_AT_MOST, _AT_LEAST = "at most", "at least"
#: Labelling functions: statistics with the bound at which they speak for a type; the first that holds is the function's vote, and it abstains if none does.
VOTES: list[list[tuple[str, str, float, str]]] = [
    [("prose_share", _AT_LEAST, 0.5, "prose"), ("prose_share", _AT_MOST, 0.5, "other")],
    [("common_share", _AT_LEAST, 0.22, "prose"), ("common_share", _AT_MOST, 0.12, "other")],
    [("symbol_ratio", _AT_LEAST, 0.25, "other"), ("symbol_ratio", _AT_MOST, 0.12, "prose")],
    [("digit_ratio", _AT_LEAST, 0.15, "other"), ("digit_ratio", _AT_MOST, 0.04, "prose")],
    [("ended_share", _AT_LEAST, 0.5, "prose"), ("ended_share", _AT_MOST, 0.05, "other")],
    [("item_share", _AT_LEAST, 0.6, "list"), ("item_share", _AT_MOST, 0.02, "prose")],
    [("table_share", _AT_LEAST, 0.5, "table"), ("table_share", _AT_MOST, 0.05, "prose")],
    [("list_share", _AT_LEAST, 0.5, "list")],
    [("long_line_share", _AT_LEAST, 0.7, "prose"), ("long_line_share", _AT_MOST, 0.2, "other")],
    [("shown_share", _AT_LEAST, 0.9, "prose"), ("shown_share", _AT_MOST, 0.5, "junk")],
    [("n_words", _AT_MOST, 0.0, "junk")],
    [("line_repeats", _AT_LEAST, 0.75, "repeated"), ("looped_share", _AT_LEAST, 0.5, "repeated"), ("mean_word_length", _AT_LEAST, 40.0, "repeated")],
]


def _votes(stats: DataFrame) -> list[Column]:
    """For each function, the place of its first rule that speaks for the same type; the number of its rules if it abstains."""
    # Of a few lines, some may repeat by chance.
    repeats = F.when(F.col("n_lines") >= 8, 1 - F.col("different_share")).otherwise(0.0)
    value = lambda name: repeats if name == "line_repeats" else F.col(name)
    out = []
    for rules in VOTES:
        vote = None
        for name, side, bound, kind in rules:
            holds, i = value(name) >= bound if side == _AT_LEAST else value(name) <= bound, [k for *_, k in rules].index(kind)
            vote = F.when(holds, i) if vote is None else vote.when(holds, i)
        out.append(vote.otherwise(len(rules)).cast("int"))
    return out


def learn(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log share of each type, and for each function the log likelihood (vote, type) of its votes, from counts of vote patterns.

    Starts from what the votes speak for. Each type has its own vote rates, with one count added to each, so functions may abstain. Repeats define their type:
    a vote for them from another type, or none from this, is at most ``UNHEARD`` likely, so a type of few texts doesn't dissolve among those that read alike.
    """
    if not patterns:
        return np.zeros(len(TYPES)), [np.zeros((len(rules) + 1, len(TYPES))) for rules in VOTES]
    v, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    speaks = [np.array([[SPEAKS[kind].get(t, 0.0) for t in TYPES] for *_, kind in rules] + [[0.0] * len(TYPES)]) for rules in VOTES]

    def posterior(log: np.ndarray) -> np.ndarray:
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    held = posterior(sum(s[v[:, f]] for f, s in enumerate(speaks)))
    one_hot = [np.eye(len(rules) + 1)[v[:, f]] for f, rules in enumerate(VOTES)]
    for _ in range(rounds):
        mass = held * n[:, None]
        prior = np.log(mass.sum(axis=0) + 1)
        rates = [np.log((h.T @ mass + 1) / (mass.sum(axis=0) + h.shape[1])) for h in one_hot]
        for rules, rate in zip(VOTES, rates, strict=True):
            if rules[0][3] == "repeated":
                unlike = np.array([[t != "repeated" for t in TYPES]] * len(rules) + [[t == "repeated" for t in TYPES]])
                rate[unlike] = np.minimum(rate[unlike], np.log(UNHEARD))
        new = posterior(prior + sum(r[v[:, f]] for f, r in enumerate(rates)))
        if np.abs(new - held).max() < 1e-9:
            break
        held = new
    return prior, rates


def text_types(df: DataFrame, key: str = "doc_id", column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of each document with ``p_prose`` and ``p_type``, the posteriors of prose and of ``text_type``, the likeliest of prose, list, table and junk, or empty."""
    stats = cut(statistics(df, key, column, keep))
    # A pattern of votes as one number; each vote is a digit of its own base.
    sizes = [len(rules) + 1 for rules in VOTES]
    strides = np.cumprod([1, *sizes[:-1]]).tolist()
    code = F.lit(0)
    for vote, stride in zip(_votes(stats), strides, strict=True):
        code = code + vote * stride
    coded = stats.withColumn("_code", F.when(F.col("n_lines") > 0, code))
    counts = sorted(map(tuple, coded.where("_code is not null").groupBy("_code").count().collect()))  # at most the product of the numbers of votes, however many documents
    patterns = [(tuple(c // stride % size for stride, size in zip(strides, sizes, strict=True)), n) for c, n in counts]
    prior, rates = learn(patterns)
    rows = []
    for (number, _), (pattern, _) in zip(counts, patterns, strict=True):
        p = np.exp((log := prior + sum(r[v] for v, r in zip(pattern, rates, strict=True))) - log.max())
        prose, list_, table, junk, repeated = (p / p.sum()).tolist()
        kinds = {"prose": prose, "list": list_, "table": table, "junk": junk + repeated}
        best = max(kinds, key=lambda k: kinds[k])
        rows.append((number, round(prose, 6), round(kinds[best], 6), best))
    posteriors = df.sparkSession.createDataFrame(rows, "_code int, p_prose double, p_type double, text_type string")
    out = coded.join(F.broadcast(posteriors), "_code", "left")
    # Without a line to vote on, a text is empty, or junk if it is nothing but markup and blanks.
    blank, nothing = F.col("n_chars") == 0, F.col("_code").isNull()
    fill = {"p_prose": F.when(nothing & ~blank, 0.0).otherwise(F.col("p_prose")), "p_type": F.when(nothing & ~blank, 1.0).otherwise(F.col("p_type")), "text_type": F.when(nothing & blank, "empty").when(nothing, "junk").otherwise(F.col("text_type"))}
    return out.withColumns(fill).drop("_code")


def not_prose(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key): the documents, not blank, of which the larger part is entries, rows or junk."""
    filled = df.where(F.col(column).rlike(r"(?U)[^\s\p{Z}\p{Cf}]"))
    return text_types(filled, key, column).where("p_prose < 0.5").select(key)
