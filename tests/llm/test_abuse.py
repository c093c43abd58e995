from __future__ import annotations

import random

import numpy as np
import pytest

from lanternfish.llm import abuse as A

BAD, GOOD = ["vile zorp scum", "zorps must vanish", "quux filth"], ["zorp dance", "old mill", "river quux lamp", "harbour light"]


def rows(seed=1, n=200):
    r = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        tags = ", ".join(r.sample(["lamp", "mill", "sea", "fog", "bell"], 3))
        title = (r.choice(BAD) if bad else r.choice(GOOD)) + f" {i}"
        out.append((f"{'met' if i % 2 else 'ov'}:{i}", title, tags))
        if i < 120:
            labels += [(out[-1][0], "r1", int(bad)), (out[-1][0], "r2", None)]
    return out, labels


@pytest.fixture(scope="module")
def data(spark):
    out, labels = rows()
    out += [("ov:x", "V1le z.o.r.p scuuum", None), ("ov:y", None, "mill; Z0RPS must v4nish"), ("ov:z", None, None), ("ov:z", None, None), (None, "vile zorp scum", ""), ("ov:long", "mill " * 50_000, "")]
    return spark.createDataFrame(out, "id string, title string, tags string"), spark.createDataFrame(labels, "id string, rater string, unsafe int")


def test_held_out_accuracy(data, cluttered):
    got = {r.id for r in A.flagged(cluttered(data[0]), data[1]).collect()}
    bad = {i for i, t, _ in rows()[0] if any(t.startswith(b) for b in BAD)}
    assert got == bad | {"ov:x", "ov:y"}


def test_scores_evidence_and_rates(data):
    got = {r.id: r for r in A.scores(*data).collect()}
    assert got["ov:y"].part == "Z0RPS must v4nish" and got["ov:y"].evidence and got["ov:z"].score == 0.0 and len(got) == 204
    rates = {r.source: r for r in A.rates(*data).collect()}
    assert rates["ov"].images + rates["met"].images == 204 and rates["met"].flagged == 0 and rates["ov"].flagged == 52


def test_no_labels_and_no_rows(data):
    assert A.flagged(data[0], data[1].limit(0)).count() == 0
    assert A.scores(data[0].limit(0), data[1]).count() == 0


def test_grams():
    texts = ["abab", "a", "", "é\U0001f600xyz", "abab"]
    owner, number = A.grams(texts)
    cut = lambda t: {f"^{t}$"[i : i + n] for n in A.SIZES for i in range(len(t) + 3 - n)}
    held = [set(number[owner == i].tolist()) for i in range(len(texts))]
    assert [len(h) for h in held] == [len(cut(t)) for t in texts] and held[0] == held[4]
    assert len(held[0] & set(A.grams(["babab"])[1].tolist())) == len(cut("abab") & cut("babab"))
    assert len(A.grams([])[0]) == 0


def test_block_max_search_is_exact():
    r = random.Random(3)
    texts = sorted({"".join(r.choices("abcde", k=r.randint(4, 12))) for _ in range(300)})
    vocabulary = A._vocabulary(texts)
    weights = np.array([r.uniform(0.5, 5) for _ in vocabulary] + [6.0])
    weight = {int(g): w for g, w in zip(vocabulary, weights[:-1], strict=True)}
    cut = lambda t: {int(g): weight.get(int(g), 6.0) for g in A.grams([t])[1]}
    index = A.Index(texts, vocabulary, weights)
    asked = ["".join(r.choices("abcdef", k=9)) for _ in range(40)] + ["zz"]
    want = {}
    for q, text in enumerate(asked):
        own = cut(text)
        for i, t in enumerate(texts):
            other = cut(t)
            c = sum(w * w for g, w in own.items() if g in other) / np.sqrt(sum(w * w for w in own.values()) * sum(w * w for w in other.values()))
            if c >= 0.3:
                want[q, i] = c
    owner, at, cosine = index.near(A.Grams(asked, vocabulary, weights), 0.3)
    assert {(int(q), int(i)): pytest.approx(c) for q, i, c in zip(owner, at, cosine, strict=True)} == want
    assert len(A.Index([], vocabulary, weights).near(A.Grams(asked, vocabulary, weights), 0.3)[0]) == 0


def test_postings_of_dead_blocks_are_not_read(monkeypatch):
    texts = sorted(f"{w}{i:03d}x" for w in ("abcdefgh", "abzyxwvu") for i in range(200))
    vocabulary = A._vocabulary(texts)
    ones = np.ones(len(vocabulary) + 1)
    index, read, plain = A.Index(texts, vocabulary, ones), [], A._spread
    monkeypatch.setattr(A, "_spread", lambda a, b: read.append(int((b - a).sum())) or plain(a, b))
    owner, _, _ = index.near(A.Grams(["abcdefgh"], vocabulary, ones), 0.5)
    at = A._found(vocabulary, A.grams(["abcdefgh"])[1])
    held = sum(int((index.to - index.from_)[index.entries[i] : index.entries[i + 1]].sum()) for i in at if i >= 0)
    assert len(owner) == 200 and read[1] < held  # those that share "ab" alone are held in the lists, and not read


def test_reliability(data):
    bins = A.reliability(*data).collect()
    assert sum(b.images for b in bins) == 120
    assert all(b.unsafe_share > 0.9 for b in bins if b.at_least >= 0.5) and all(b.unsafe_share < 0.1 for b in bins if b.at_least < 0.3)


def test_skeletons():
    for a, b in (("P-o.rn", "porn"), ("$c u m", "scum"), ("аbc", "abc"), ("Wanke​ee r.jpg", "wanker"), ("xxx", "xxx"), ("Café", "cafe"), ("2003", "")):
        assert A.skeleton(a) == b
