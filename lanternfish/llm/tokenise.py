"""Problem 8: encoding of a corpus with a public byte-level BPE tokenizer, by speculation and verification.

A segmentation of a word is the one BPE makes exactly when no merge crosses any border between two adjacent tokens. So a greedy
longest match proposes tokens, the borders of all proposed words of a batch are checked in one vectorised pass over the merge table,
and only the words with a border that fails are merged step by step. The pass over the corpus is a map without a shuffle.

Defined cases: null or empty text gives an empty list; text that looks like a special token is plain text; words of any length are
encoded whole (the exact merge is O(n log n)); repeated texts and extra columns are untouched.
"""

from __future__ import annotations

import ast
import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Words kept by a worker between batches; a bound on memory that changes no result.
KEPT_WORDS = 200_000
#: Merges above any rank: the token is a whole word and is merged no further.
NEVER = 1 << 30


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> tuple[str, str, str]:
    """Ranks file, merges file and word pattern of a public tokenizer."""
    if folder is None:
        import public_tokenizers as public

        return public.path(f"{name}.tiktoken"), public.path(f"{name}.json"), public.PATTERN
    from pathlib import Path

    lines = (Path(folder) / "__init__.py").read_text().splitlines()
    pattern = next(line.split("=", 1)[1] for line in lines if line.startswith("PATTERN"))
    return f"{folder}/{name}.tiktoken", f"{folder}/{name}.json", ast.literal_eval(pattern.strip())


class Encoder:
    """Vocabulary, merge table and border check of one tokenizer."""

    def __init__(self, ranks_file: str, merges_file: str, pattern: str) -> None:
        import regex

        with open(ranks_file, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(merges_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([letters[a] for a, _ in merges], np.int64)
        right = np.array([letters[b] for _, b in merges], np.int64)
        made = np.array([letters[a + b] for a, b in merges], np.int64)
        size = max(self.ids.values()) + 2
        self.size = size
        self.merge = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        order = np.argsort(left * size + right)
        self.keys, self.key_ranks = (left * size + right)[order], np.arange(len(merges))[order]
        # Right-hand and left-hand descent of each token: the parts that lie at its border, each with the rank that merges it away.
        part, rank = {"right": np.arange(size), "left": np.arange(size)}, np.full(size, -1)
        part["right"][made], part["left"][made], rank[made] = right, left, np.arange(len(merges))
        self.rank = rank
        self.descent = {side: self._descents(part[side], rank) for side in part}
        self.longest = max(map(len, self.ids))
        self.words = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}

    @staticmethod
    def _descents(part: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        levels, token, until = [], np.arange(len(part)), np.full(len(part), NEVER)
        while True:
            levels.append((token, until))
            lower = part[token]
            if (lower == token).all():
                return levels
            ends = token == lower
            token, until = lower, np.where(ends, -1, rank[token])  # -1: no such level, and nothing can merge there

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; every single byte is a token, so it always ends."""
        out, at, ids, longest = [], 0, self.ids, self.longest
        while at < len(word):
            for end in range(min(len(word), at + longest), at, -1):
                if (one := ids.get(word[at:end])) is not None:
                    out.append(one)
                    at = end
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each border a|b, whether no merge crosses it: none of the parts at the border meet while both are there."""
        good = np.ones(len(a), bool)
        for left, left_until in self.descent["right"]:
            for right, right_until in self.descent["left"]:
                key = left[a] * self.size + right[b]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[at] == key, self.key_ranks[at], NEVER)
                good &= (rank == NEVER) | (rank > left_until[a]) | (rank > right_until[b])
        return good

    def exact(self, word: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost first, until none is left."""
        token: list[int] = [self.ids[word[i : i + 1]] for i in range(len(word))]
        before, after = list(range(-1, len(token) - 1)), list(range(1, len(token) + 1))
        heap = [(self.merge[p][0], i, p) for i in range(len(token) - 1) if (p := (token[i], token[i + 1])) in self.merge]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if token[i] >= 0 else len(token)
            if j >= len(token) or (token[i], token[j]) != pair:
                continue
            token[i], token[j] = self.merge[pair][1], -1
            after[i] = after[j]
            if after[i] < len(token):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(token) and (p := (token[x], token[y])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], x, p))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        proposed = [[one] if (one := self.ids.get(w)) is not None else self.propose(w) for w in raw]
        lengths = np.array([len(p) for p in proposed])
        flat = np.array([t for p in proposed for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        border, which = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        failed = ~self.compatible(border // self.size, border % self.size)[which]
        for i in np.unique(owner[inner[failed]]):
            proposed[i] = self.exact(raw[i])
        return proposed

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        kept = self.kept.__getitem__
        return [np.frombuffer(b"".join(map(kept, words)), np.int32) for words in self._words(texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text."""
        kept = self.kept.__getitem__
        return [sum(map(len, map(kept, words))) // 4 for words in self._words(texts)]

    def _words(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of which are encoded and kept afterwards."""
        split = [self.words.findall(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.kept})
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            new = list({w for words in split for w in words})
        if new:
            self.kept.update(zip(new, (np.array(x, np.int32).tobytes() for x in self.encode_words(new)), strict=True))
        return split


@lru_cache(maxsize=2)
def encoder(ranks_file: str, merges_file: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(ranks_file, merges_file, pattern)


def with_ids(df: DataFrame, column: str = "text", to: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str | None = None, slice_rows: int = 512) -> DataFrame:
    """Adds ``to``, the list of token ids of ``column``."""
    files = vocabulary_path(tokenizer, folder)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*files)
        for whole in batches:
            for start in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(start, slice_rows)
                ids = own.encode(batch.column(at).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, to])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(to, ArrayType(IntegerType(), False))]))


def document_ids(df: DataFrame, key: str = "doc_id", column: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): one row per document."""
    return with_ids(df.select(F.col(key), F.col(column)), column, "ids", tokenizer, folder).select(key, "ids")


def token_counts(df: DataFrame, column: str = "text", to: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str | None = None, slice_rows: int = 512) -> DataFrame:
    """Adds ``to``, the number of tokens of ``column``: 0 for null or empty."""
    files = vocabulary_path(tokenizer, folder)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*files)
        for whole in batches:
            for start in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(start, slice_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.count(batch.column(at).to_pylist()), pa.int32())], names=[*batch.schema.names, to])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(to, IntegerType())]))
