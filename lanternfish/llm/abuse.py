"""Problem 6: abusive, hateful or sexually explicit titles and tags, by nearest labelled examples.

A text is its title and each of its tags, as skeletons: letters only, look-alikes and signs typed for letters undone, repeats
of a letter merged, so spacing and disguises change little. Every different skeleton is rated once, however many images have it. Skeletons are compared by exact TF-IDF
cosine of character n-grams; document frequencies count every part of every image. The examples are in a block-max inverted index: for each n-gram the greatest
weight in each block of examples bounds the cosine of all of them. A batch of skeletons first adds up the bounds; the postings of a block are read only for those skeletons
whose bound in it reaches ``least``. The nearest examples vote, weighted by their cosine; the score of an image is that of its worst part, with the nearest unsafe
example as evidence. ``reliability`` compares scores with held-out ratings.

Raters label images, not parts: in an unsafe image, parts that the other examples rate safe while another part explains the label lose their vote.

The model is fitted on at most ``most_examples`` labelled images (the least hashes of the ids) with ``most_letters`` letters in all, which bounds what is collected and
broadcast; everything else covers all rows. Defined cases: null title and tags score 0; images without labels and labels without images are allowed; null ratings are
no ratings; without any example every score is 0; an id counts once (the least title and tags); null ids are left out; texts of any length count whole; equal cosines go
to the earlier example in order of its skeleton.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.llm.lookalike import SINGLES
from lanternfish.operators.packed_values import pieces
from lanternfish.session import cut

# Signs and digits that are typed for letters.
TYPED = {"$": "s", "@": "a", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "€": "e"}
EXTENSION = re.compile(r"\.(?:jpe?g|png|tiff?|webp|gif)\s*$", re.IGNORECASE)
APART = re.compile(r"[\s_\-,.;:()\[\]{}/\"“”'’|&+=#]+")
REPEATED = re.compile(r"(.)\1+")
#: A run without a sign that stands apart, with a letter in it, of lower-case ASCII.
ASCII_TOKEN = re.compile(r"[^\s_\-,.;:()\[\]{}/\"'|&+=#]*[a-z][^\s_\-,.;:()\[\]{}/\"'|&+=#]*")
ASCII_TYPED, NO_LETTER = str.maketrans({k: v for k, v in TYPED.items() if k.isascii()}), re.compile("[^a-z]+")
SIZES = (3, 4, 5)
BLOCK = 16
PARTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("s", T.StringType()), T.StructField("part", T.StringType())])
RATED = T.StructType([T.StructField("s", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.StringType()), T.StructField("cosine", T.DoubleType())])


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    hidden = {c: None for c in (*range(0x10000), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(c)) == "Cf"}
    return hidden | {ord(a): b for a, b in zip(*SINGLES, strict=True)}


@lru_cache(maxsize=20_000)
def skeleton(text: str) -> str:
    if text.isascii():  # the same in fewer steps, for most texts
        tokens = ASCII_TOKEN.findall(EXTENSION.sub("", text).lower())
        joined = NO_LETTER.sub("", "".join(tokens).translate(ASCII_TYPED))
        if joined == joined[:1] * len(joined):  # one letter alone: three of it stay, apart or not
            sizes = [len(NO_LETTER.sub("", t.translate(ASCII_TYPED))) for t in tokens]
            return joined[:1] * (3 if sum(n if n == 3 else min(n, 1) for n in sizes) == 3 else 1)
        return REPEATED.sub(r"\1", joined)
    plain = EXTENSION.sub("", text.translate(_table()))
    plain = "".join(c for c in unicodedata.normalize("NFKD", plain.lower()) if not unicodedata.combining(c))
    out = []
    for token in APART.split(plain):
        if any(c.isalpha() for c in token):
            letters = "".join(c for x in token if (c := TYPED.get(x, x)).isalpha())
            out.append(letters if len(set(letters)) == 1 and len(letters) == 3 else REPEATED.sub(r"\1", letters))
    joined = "".join(out)
    return joined if joined == joined[:1] * 3 else REPEATED.sub(r"\1", joined)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number): the different n-grams of each text with its borders, as numbers of 48 bits, in order of text and number. A number shared by chance counts as the same n-gram."""
    edged = [f"^{t}$" for t in texts]
    sizes = np.fromiter(map(len, edged), np.int64, len(edged))
    points = np.frombuffer("".join(edged).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner, keys = np.repeat(np.arange(len(edged)), sizes), []
    for n in SIZES:
        last = len(points) - n + 1
        if last < 1:
            continue
        h = np.full(last, n, np.uint64)
        for i in range(n):
            h = (h ^ points[i : i + last]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:last] == owner[n - 1 :]
        keys.append((owner[:last][inside].astype(np.uint64) << np.uint64(48)) | (h[inside] >> np.uint64(16)))
    keys = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64(2**48 - 1)


def _found(vocabulary: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The place of each number in the sorted vocabulary; -1 if it is not there."""
    if not len(vocabulary):
        return np.full(len(number), -1)
    at = np.minimum(np.searchsorted(vocabulary, number), len(vocabulary) - 1)
    return np.where(vocabulary[at] == number, at, -1)


def parts(title: str | None, tags: str | None) -> dict[str, str]:
    """The skeletons of title and tags, each with the text it comes from."""
    out = {}
    if title and len(s := skeleton.__wrapped__(title)) > 1:  # titles hardly ever repeat, tags do and are kept
        out[s] = title
    if tags:
        out |= {s: p[0] for p in pieces(tags) if len(s := skeleton(p[0])) > 1}
    return out


class Grams:
    """The n-grams of a batch of skeletons as flat arrays: whose they are, their numbers in a vocabulary (-1 if in none) and their weights in unit vectors."""

    def __init__(self, texts: list[str], vocabulary: np.ndarray, idf: np.ndarray) -> None:
        self.count = len(texts)
        self.owner, number = grams(texts)
        self.number = _found(vocabulary, number)
        weight = idf[self.number]  # the last is the weight of n-grams that are not in the vocabulary
        norm = np.sqrt(np.bincount(self.owner, weight * weight, len(texts)))
        self.weight = weight / np.where(norm > 0, norm, 1)[self.owner]

    def only(self, wanted: np.ndarray) -> Grams:
        """The same batch with the n-grams of the wanted skeletons alone."""
        out = Grams.__new__(Grams)
        kept = wanted[self.owner]
        out.count, out.owner, out.number, out.weight = self.count, self.owner[kept], self.number[kept], self.weight[kept]
        return out


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges one after the other, and the range of each."""
    sizes = end - start
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - (np.cumsum(sizes) - sizes)[which] + start[which], which


class Index:
    """Block-max inverted index of the unit vectors of examples, in flat arrays. An entry is an n-gram in a block, with its bound and its range of postings."""

    def __init__(self, texts: list[str], vocabulary: np.ndarray, idf: np.ndarray) -> None:
        own = Grams(texts, vocabulary, idf)
        self.size, self.blocks = len(texts), -(-len(texts) // BLOCK)
        order = np.lexsort((own.owner, own.number))
        number, self.at, self.weight = own.number[order], own.owner[order], own.weight[order]
        block = self.at // BLOCK
        first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (block[1:] != block[:-1])]) if len(number) else np.empty(0, np.int64)
        self.block, self.bound = block[first], np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.from_, self.to = first, np.r_[first[1:], len(number)] if len(first) else first
        self.entries = np.searchsorted(number[first], np.arange(len(vocabulary) + 1))

    def near(self, batch: Grams, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(skeleton, example, cosine) of all pairs with at least the cosine ``least``, in order of skeleton and example."""
        known = np.flatnonzero(batch.number >= 0)
        entry, gram = _spread(self.entries[batch.number[known]], self.entries[batch.number[known] + 1])
        gram = known[gram]
        place = batch.owner[gram] * self.blocks + self.block[entry]
        bound = np.bincount(place, batch.weight[gram] * self.bound[entry], batch.count * self.blocks)
        alive = bound >= least - 1e-9
        kept = alive[place]  # the postings of all other entries are never read
        live = np.flatnonzero(alive)
        number = np.zeros(len(alive), np.int64)
        number[live] = np.arange(len(live))
        entry, gram, place = entry[kept], gram[kept], number[place[kept]]
        posting, which = _spread(self.from_[entry], self.to[entry])
        at = self.at[posting]
        cosine = np.bincount(place[which] * BLOCK + at % BLOCK, self.weight[posting] * batch.weight[gram[which]], len(live) * BLOCK)
        found = np.flatnonzero(cosine >= least)
        owner, block = live[found // BLOCK] // max(self.blocks, 1), live[found // BLOCK] % max(self.blocks, 1)
        return owner, block * BLOCK + found % BLOCK, cosine[found]


class Model:
    """Examples with their unsafe and safe votes. ``doubt`` is the weight of one more safe vote in every score, so that one rating alone decides nothing far."""

    def __init__(self, labelled: list[tuple[float, int, list[str]]], expected: dict[str, float], vocabulary: np.ndarray, idf: np.ndarray, least: float = 0.35, k: int = 15, rounds: int = 3, doubt: float = 0.15) -> None:
        self.least, self.k, self.doubt = least, k, doubt
        votes: dict[str, np.ndarray] = {}
        for y, n, own in labelled:
            for s in own:
                votes.setdefault(s, np.zeros(2))[:] += (y * n, (1 - y) * n)
        # A part in many images of which hardly any was rated unsafe is safe: of the others, as many as would have been rated count as safe votes.
        for s, own in votes.items():
            own[1] += expected.get(s, 0.0)
        self.texts = sorted(votes)
        self.vocabulary, self.idf = vocabulary, idf
        self.whole = Index(self.texts, self.vocabulary, self.idf)
        self.place = place = {s: i for i, s in enumerate(self.texts)}
        base = np.array([votes[s] for s in self.texts]).reshape(-1, 2)
        self.bad, self.good = base[:, 0].copy(), base[:, 1].copy()
        near = self.neighbours([s for y, _, own in labelled if y > 0.5 for s in own])
        for _ in range(rounds):
            bad = base[:, 0].copy()
            for y, n, own in labelled:
                if y <= 0.5 or len(own) < 2:
                    continue
                # The part to blame is the one with most unsafe, or without safe, examples near it besides this image.
                blame = {s: (b + 0.05) / (w + 0.1) for s in own for b, w in [self._votes(*near[s], less=([place[s]], y * n, 0.0))]}
                top = max(blame.values())
                for s, share in blame.items():
                    if share < 0.9 * top:
                        bad[place[s]] -= y * n
            self.bad = np.maximum(bad, 0)
        self.which = np.flatnonzero(self.bad > self.good)
        self.unsafe = Index([self.texts[i] for i in self.which], self.vocabulary, self.idf)

    def batch(self, texts: list[str]) -> Grams:
        return Grams(texts, self.vocabulary, self.idf)

    def neighbours(self, texts: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The places and cosines of all examples near each text."""
        out = {}
        for i in range(0, len(texts), 512):
            part = texts[i : i + 512]
            owner, at, cosine = self.whole.near(self.batch(part), self.least)
            ends = np.searchsorted(owner, np.arange(len(part) + 1))
            out |= {s: (at[a:b], cosine[a:b]) for s, a, b in zip(part, ends, ends[1:], strict=False)}
        return out

    def _votes(self, at: np.ndarray, cosine: np.ndarray, less: tuple[list[int], float, float] | None = None) -> tuple[float, float]:
        """Unsafe and all votes of the k nearest, weighted by the square of the cosine above the least; without the votes of one image: its places, unsafe and safe votes."""
        order = np.lexsort((at, -cosine))[: self.k]
        at, weight = at[order], (cosine[order] - self.least * 0.9) ** 2
        bad, good = self.bad[at].copy(), self.good[at].copy()
        if less is not None:
            own = np.isin(at, less[0])
            bad[own], good[own] = np.maximum(bad[own] - less[1], 0), np.maximum(good[own] - less[2], 0)
        # An example's own ratings count up to a few, so that one frequent safe tag doesn't outvote all others.
        total = bad + good
        trust = np.minimum(total, 4.0)
        share = np.divide(bad, total, out=np.zeros_like(bad), where=total > 0)
        return float((weight * trust * share).sum()), float((weight * trust).sum())

    def rate(self, texts: list[str]) -> list[tuple[str, float, str, float]]:
        """(text, score, nearest unsafe example, its cosine) of the texts with an unsafe example near; the score of all others is 0, and their votes are not needed."""
        batch = self.batch(texts)
        owner, at, cosine = self.unsafe.near(batch, self.least)
        if not len(owner):
            return []
        wanted = np.zeros(len(texts), bool)
        wanted[owner] = True
        all_owner, all_at, all_cosine = self.whole.near(batch.only(wanted), self.least)
        out = []
        for i in np.flatnonzero(wanted):
            a, b = np.searchsorted(owner, [i, i + 1])
            best = a + int(np.lexsort((at[a:b], -cosine[a:b]))[0])
            c, d = np.searchsorted(all_owner, [i, i + 1])
            bad, every = self._votes(all_at[c:d], all_cosine[c:d])
            out.append((texts[i], bad / (every + self.doubt), self.texts[self.which[at[best]]], float(cosine[best])))
        return out

    def held_out(self, labelled: list[tuple[float, int, list[str]]]) -> list[tuple[float, float]]:
        """(score, label) of each labelled image when its own ratings count nothing."""
        near = self.neighbours(sorted({s for *_, own in labelled for s in own}))
        out = []
        for y, n, own in labelled:
            less = [self.place[s] for s in own if s in self.place]
            sums = [self._votes(*near[s], less=(less, y * n, (1 - y) * n)) for s in own]
            out.append((max([b / (w + self.doubt) for b, w in sums], default=0.0), y))
        return out


def image_parts(images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images (id), their parts (id, s, part) and the different skeletons (s, n) with the number of images that have them. Texts are cut and brought to skeletons once."""
    one = cut(images.where("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.min("title").alias("title"), F.min("tags").alias("tags")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2_048):
                batch = whole.slice(start, 2_048)
                rows = [(i, s, t) for i, title, tags in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s, t in parts(title, tags).items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], names=PARTS.names)

    held = cut(one.select("id", "title", "tags").mapInArrow(run, PARTS))
    return one.select("id"), held, cut(held.groupBy("s").agg(F.count("*").alias("n")))


def _vocabulary(texts: list[str]) -> np.ndarray:
    """The different n-grams of all texts, in order."""
    return np.unique(np.concatenate([grams(texts[i : i + 1_024])[1] for i in range(0, len(texts), 1_024)]))


def _frequencies(skeletons: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many parts of images each n-gram of the vocabulary occurs. The result has at most as many rows as the vocabulary."""
    shared = skeletons.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1_024):
                batch = whole.slice(start, 1_024)
                owner, number = grams(batch.column(0).to_pylist())
                at = _found(known, number)
                counts += np.bincount(at[at >= 0], batch.column(1).to_numpy()[owner[at >= 0]], len(known)).astype(np.int64)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], names=["at", "n"])

    out = np.zeros(len(vocabulary))
    for at, n in skeletons.select("s", "n").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out


def fit(one: DataFrame, held: DataFrame, skeletons: DataFrame, labels: DataFrame, most_examples: int = 20_000, most_letters: int = 2_000_000, rarest: float = 0.0005, **how: float) -> tuple[Model, list[tuple[float, int, list[str]]]] | None:
    """The model from ratings (id, unsafe) of the images, and what it was fitted on. N-grams rarer than the share ``rarest`` of all images weigh as if they were not."""
    rated = labels.where("id is not null and unsafe is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.avg("unsafe").alias("y"), F.count("*").alias("n"))
    sized = held.join(rated, "id").groupBy("id", "y", "n").agg(F.sum(F.length("s")).alias("letters")).orderBy(F.xxhash64("id"), "id").limit(most_examples)
    upto = F.sum("letters").over(W.orderBy(F.xxhash64("id"), "id").rowsBetween(W.unboundedPreceding, W.currentRow))  # over at most most_examples rows
    chosen = sized.withColumn("upto", upto).where(F.col("upto") <= most_letters).select("id", "y", "n")
    rows = held.join(F.broadcast(chosen), "id").groupBy("id", "y", "n").agg(F.sort_array(F.collect_list("s")).alias("own")).collect()
    labelled = [(float(r.y), int(r.n), list(r.own)) for r in sorted(rows, key=lambda r: r.id)]
    texts = {s for *_, own in labelled for s in own}
    if not texts:
        return None
    vocabulary = _vocabulary(sorted(texts))
    counts = _frequencies(skeletons, vocabulary)
    examples = skeletons.sparkSession.createDataFrame([(s,) for s in sorted(texts)], "s string")
    frequent = dict(map(tuple, skeletons.join(F.broadcast(examples), "s").select("s", "n").collect()))
    total = one.count()
    own = Counter(s for *_, parts_ in labelled for s in parts_)
    rated_share, least = len(labelled) / max(total, 1), max(1.0, rarest * total)
    idf = np.log(1 + total / np.maximum(np.append(counts, 0), least))
    return Model(labelled, {s: max(n - own[s], 0) * rated_share for s, n in frequent.items()}, vocabulary, idf, **how), labelled


def scores(images: DataFrame, labels: DataFrame, **how: float) -> DataFrame:
    """(id, score, part, evidence, cosine): one row per image id, with its worst part and the unsafe example nearest to it."""
    one, held, skeletons = image_parts(images)
    fitted = fit(one, held, skeletons, labels, **how)
    if fitted is None:
        return one.select("id", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("evidence"), F.lit(0.0).alias("cosine"))
    shared = images.sparkSession.sparkContext.broadcast(fitted[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1_024):
                rows = shared.value.rate(whole.column(0).slice(start, 1_024).to_pylist())
                cols = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.string(), pa.float64()), strict=True)], names=RATED.names)

    rated = cut(skeletons.select("s").mapInArrow(run, RATED))
    worst = held.join(rated, "s").groupBy("id").agg(F.max_by(F.struct("score", "part", "evidence", "cosine"), F.struct("score", F.hash("s"))).alias("w"))
    return one.join(worst, "id", "left").select("id", F.coalesce("w.score", F.lit(0.0)).alias("score"), "w.part", "w.evidence", F.coalesce("w.cosine", F.lit(0.0)).alias("cosine"))


def reliability(images: DataFrame, labels: DataFrame, borders: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), **how: float) -> DataFrame:
    """(at_least, images, mean_score, unsafe_share): of the labelled images whose score without their own ratings lies from one border to the next, how many are unsafe."""
    spark = images.sparkSession
    fitted = fit(*image_parts(images), labels, **how)
    rows = [] if fitted is None else fitted[0].held_out(fitted[1])
    binned = [(max(b for b in borders if s >= b), s, float(y > 0.5)) for s, y in rows]
    return spark.createDataFrame(binned, "at_least double, score double, unsafe double").groupBy("at_least").agg(F.count("*").alias("images"), F.round(F.avg("score"), 3).alias("mean_score"), F.round(F.avg("unsafe"), 3).alias("unsafe_share"))


def flagged(images: DataFrame, labels: DataFrame, threshold: float = 0.4, **how: float) -> DataFrame:
    """(id) of the images to be reviewed."""
    return scores(images, labels, **how).where(F.col("score") >= threshold).select("id")


def rates(images: DataFrame, labels: DataFrame, threshold: float = 0.4, **how: float) -> DataFrame:
    """(source, images, flagged, rate, mean_score) of each source, the part of the id before the colon."""
    scored = scores(images, labels, **how).withColumn("source", F.substring_index("id", ":", 1))
    hit = (F.col("score") >= threshold).cast("int")
    return scored.groupBy("source").agg(F.count("*").alias("images"), F.sum(hit).alias("flagged"), F.round(F.avg(hit), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
