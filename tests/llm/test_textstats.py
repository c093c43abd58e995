from __future__ import annotations

import numpy as np
import pytest

from lanternfish.llm import textstats as S

PROSE = [
    "The granary at Fjäl in autumn, seen from the lower meadow.", "Une lampe trouvée à Pell.", "<p>It was the best goblet I had ever seen, the owner told us.</p>\n<p>And I would not sell it for anything.</p>", "Th% %wn%r t%ld %s th%t th% f%l% sh%%ld b% k%pt %nd th%t %t w%s %ld",
    "niemand weiß wer den brunnen gebaut hat aber die steine stammen aus der gegend", "In the foreground\nwe see a heron, while\nthe lute behind it is\nalmost hidden by fog.", "D@t@ fr0m tw0 f!lt3rs w3r3 c0mb!n3d t0 m@k3 th!s v!3w, wh!ch !s why th3 n3bul@ l00ks br!ght3r",
]
OTHER = [
    "- barn\n- rural beetle\n- boathouse\n- kettle Wex\n- anvil", "name,year,place\nlynx,1902,Thor\nkiln,1871,Halm\nweir,1999,Dún", "| name | year |\n|---|---|\n| lock | 1946 |", "<table><tr><td>barn</td><td>1871</td></tr><tr><td>kiln</td><td>1880</td></tr></table>", "Camera: Model 4\nExposure: 1/294\nWidth = 6904",
    "buy prints now " * 60, "907 4974742 6 959 195 2 7 640", "df132273e55163d952aaa05613fb7cea1d6857", "#*#.*~ +-=~*~_##-+ _**", "Upload | Gallery | Language | Help | Menu", "<div class='c2'><span></span></div>" * 20, "ha" * 300,
    "The barge in winter, seen from the field.\n" + "\n".join(f"#weir_{i}" for i in range(30)), "glider\nweir\natlas\nplateau Zelm\nnebula",
]


@pytest.fixture(scope="module")
def rated(spark):
    rows = [(i, t) for i, t in enumerate((PROSE + OTHER) * 8)] + [(1000, None), (1001, ""), (1002, " \n "), (1003, PROSE[0] + " " + "The mill is old and it was built by the river. " * 3000), (1004, "x, " * 60_000), (1005, "a line of the text\n" * 30_000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_kinds(rated, cluttered):
    got = {r.doc_id for r in S.not_prose(cluttered(rated)).collect()}
    n = len(PROSE + OTHER)
    assert {i % n for i in got if i < 1000} == set(range(len(PROSE), n))
    assert got & {1000, 1001, 1002, 1004, 1005} == {1004, 1005}


def test_statistics(spark):
    r = S.statistics(spark.createDataFrame([(1, "The cat sat.\nOne two\n")], "doc_id long, text string")).first()
    assert (r.n_chars, r.n_words, r.n_lines, r.ended_share) == (21, 5, 2, 0.5)
    assert r.mean_word_length == pytest.approx(15 / 5) and r.common_share == pytest.approx(0.2)
    assert S.text_types(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kinds = {r.doc_id: r.text_type for r in S.text_types(spark.createDataFrame([(1, None), (2, ""), (3, PROSE[0])], "doc_id long, text string")).collect()}
    assert kinds[1] == kinds[2] == "empty"


def test_learning_finds_the_accurate_functions():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.9, 0.6, 0.55, 0.9, 0.85]
    votes = np.zeros((4000, len(S.VOTES)), int)
    for f, rules in enumerate(S.VOTES):
        kinds = [r[3] for r in rules]
        if "prose" in kinds and f < len(accuracy):
            right = np.where(rng.random(4000) < accuracy[f], truth, ~truth)
            votes[:, f] = np.where(right, kinds.index("prose"), 1 - kinds.index("prose"))
        else:
            votes[:, f] = len(rules)
    patterns = [(tuple(p), int(c)) for p, c in zip(*np.unique(votes, axis=0, return_counts=True), strict=True)]
    prior, rates = S.learn(patterns)
    score = prior + sum(r[votes[:, f]] for f, r in enumerate(rates))
    assert ((score.argmax(axis=1) == 0) == truth).mean() > 0.97


def test_posteriors_have_no_exceptions(rated):
    """Repeats are junk by their posterior alone: without the functions that speak for it, their words read like prose."""
    got = {r.doc_id: r for r in S.text_types(rated).collect()}
    n = len(PROSE + OTHER)
    loop = (PROSE + OTHER).index("buy prints now " * 60)
    assert all(0 <= r.p_prose <= 1 and r.p_type >= 0.25 for r in got.values() if r.p_prose is not None)
    assert got[loop].text_type == got[loop + n].text_type == "junk"
