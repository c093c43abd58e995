from __future__ import annotations

import ahocorasick
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lanternfish.operators import packed_values as P

CASES = [
    ("a, b;c", ["a", "b", "c"]),
    ('"oil, canvas"; x', ["oil, canvas", "x"]),
    ('["a", "b \\"c\\" d", "e\'s"]', ["a", 'b "c" d', "e's"]),
    ("'fisherman's wharf', 'b'", ["fisherman's wharf", "b"]),
    ("#a #b", ["a", "b"]),
    ("#a#b c, #d", ["a", "b c", "d"]),
    ('{a,"b, c"}', ["a", "b, c"]),
    ('  x · "y ""z"" w" ·  q ', ["x", 'y "z" w', "q"]),
    ("black/white / b", ["black/white", "b"]),
    ("a,,b,", ["a", "b"]),
    ("“left; right”|q", ["left; right", "q"]),
    ('"""V"" steamer", q', ['"V" steamer', "q"]),
    (', "t", "u" | "v";"w"', ["t", "u", "v", "w"]),
    ('"unclosed, b', ['"unclosed', "b"]),
    ("a\r\nb\r\n", ["a", "b"]),
    ("a\tb、c，d；e", ["a", "b", "c", "d", "e"]),
    ("rock & roll;f/2.8", ["rock & roll", "f/2.8"]),
    ("x, x", ["x", "x"]),
    ("   ", []),
    ('""', []),
    ("col·lecció", ["col·lecció"]),
]


@pytest.mark.parametrize(("field", "values"), CASES)
def test_cases(field, values):
    assert [p[0] for p in P.pieces(field)] == values


@given(st.lists(st.text("abcxyz é-'", min_size=1).map(str.strip).filter(lambda x: x and x[0] not in "'#"), min_size=1, max_size=8), st.sampled_from([", ", ";", " | ", "\n", "\t", " / "]))
def test_round_trip_unquoted(values, separator):
    assert [p[0] for p in P.pieces(separator.join(values))] == values


@given(st.lists(st.text('ab,;|"/ ', min_size=1).filter(lambda x: x.strip() == x), min_size=1, max_size=6), st.sampled_from([",", "; ", " | "]))
def test_round_trip_quoted(values, separator):
    assert [p[0] for p in P.pieces(separator.join('"' + v.replace('"', '""') + '"' for v in values))] == values


def test_cover_prefers_known_whole_values():
    known = ahocorasick.Automaton()
    for v in ("oil, canvas", "a, b", "b, c, d"):
        known.add_word(v, len(v))
    known.make_automaton()
    cut = lambda field: [p[0] for p in P.cover(field, P.spans(field, known))]
    assert cut("x; oil, canvas; y") == ["x", "oil, canvas", "y"]
    assert cut("a, b, c, d") == ["a", "b, c, d"]
    assert cut("oil; canvas") == ["oil", "canvas"]


def test_a_dictionary_in_parts_gives_the_same(spark):
    """Every known value counts, whether the dictionary is sent at once or in parts."""
    rows = [(f"q{i}-{k}", f'"left{i}, right{i}", x') for i in range(40) for k in range(8)] + [(f"u{i}", f"y; left{i}, right{i}; left{i + 1}, right{i + 1}") for i in range(39)]
    df = spark.createDataFrame(rows, "id string, tags string")
    one, parts = (sorted(map(tuple, P.unpacked(df, letters=n).collect())) for n in (4_000_000, 60))
    assert one == parts
    assert [r[2] for r in one if r[0] == "u7"] == ["y", "left7, right7", "left8, right8"]


def test_parts_that_stand_alone_are_no_whole_value(spark):
    rows = [("q", '"red, blue", x'), *[(f"a{i}", "red; blue; x") for i in range(5)], ("u", "red, blue")]
    df = spark.createDataFrame(rows, "id string, tags string")
    assert [r.tag for r in P.unpacked(df).where("id = 'u'").orderBy("pos").collect()] == ["red", "blue"]


def test_operator_on_a_table(spark):
    rows = [(f"i{i}", '"oil, canvas", x', 1) for i in range(25)] + [("u", "oil, canvas; x", 1), ("one", "single", 1), ("e", " ", 1), ("n", None, 1), (None, "a,b", 1), ("u", "oil, canvas; x", 2)]
    df = spark.createDataFrame(rows, "id string, tags string, field int")
    got = {r.id: [] for r in P.unpacked_several(df).collect()}
    for r in P.unpacked_several(df).orderBy("id", "pos").collect():
        got[r.id].append((r.pos, r.tag))
    assert got["u"] == [(1, "oil, canvas"), (2, "x")] and got["i3"] == [(1, "oil, canvas"), (2, "x")]
    assert set(got) == {f"i{i}" for i in range(25)} | {"u"}
    assert P.unpacked(df).where("id = 'one'").collect()[0].tag == "single"
    assert P.unpacked_several(df.limit(0)).count() == 0


def test_long_field(spark):
    df = spark.createDataFrame([("a", ",".join(f"t{i}" for i in range(50_000)))], "id string, tags string")
    assert P.unpacked(df).count() == 50_000
