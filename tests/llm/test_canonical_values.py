from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanternfish.llm import canonical_values as C
from lanternfish.session import table

CASES = {
    "CC-BY-SA-4.0": 10, "cc by 4": 5, "CCBYSA 3.0": 9, "ＣＣ ＢＹ ２．０": 2, "{{cc-by-sa-3.0-de}}": 24, "Creative Comons Attribtuion ShareAlike 4.0 International": 10, "Photo: inky7 / CC BY 3.0 DE": 23, "https://deeds.licence-desk.example/by-nc/3.0/": 12,
    '<a href="https://deeds.licence-desk.example/by/4.0/">CC BY 4.0</a>': 5, "Namensnennung - Nicht kommerziell - Weitergabe unter gleichen Bedingungen 4.0": 19, "Attribution-Pas d'utilisation commerciale-Pas de modification 2.0": 20, "CC0": 27, "cco 1.0": 27,
    "CC Zero 1.0": 27, "PDM": 28, "Public Domain Mark": 28, "Publc Domain Mark 1.0": 28, "Public domian": 29, "dominio público": 29, "Gemeinfrei": 29, "GNU FDL 1.2": 30, "gfdl-1.3": 31, "Licence Art Libre 1.3": 32, "FAL": 32, "Open Goverment Licence v3": 33, "UK Open Government Licence 3.0": 33,
    "CC BY-SA 3.0 IGO (own work)": 26, "Creative Commons Attribution 2.0 France": 0, "GFDL": 0, "CC BY": 0, "CC": 0, "4.0": 0, "CC BY-SA 9.0": 0, "CC SA 4.0": 0, "fair use (cover art)": 0, "All rights reserved": 0, "free for personal use": 0, "© 2011 the photographer": 0, "?": 0,
}


@pytest.fixture(scope="module")
def entries(spark):
    return table(spark, "/root/testdata/sf0.001", "license_list")


def test_cases(spark, entries, cluttered):
    values = list(CASES)
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, license string")
    got = {values[int(r.id)]: r.license_id for r in C.license_ids(cluttered(df), entries).collect()}
    assert got == CASES


def test_edges(spark, entries):
    rows = [("1", None), ("2", "  "), ("3", "CC BY 4.0"), ("4", "cc by 4.0"), ("4", "cc by 4.0"), (None, "cc by 4.0"), ("5", "x " * 50_000 + "cc by 4.0")]
    df = spark.createDataFrame(rows, "id string, license string")
    assert sorted(map(tuple, C.license_ids(df, entries).collect())) == [("4", 5), ("5", 5)]
    assert C.license_ids(df.limit(0), entries).count() == 0
    assert C.license_ids(df, entries.limit(0)).where("license_id <> 0").count() == 0


def test_other_lists(spark):
    """Places and parts, mistyped, with words around them, or none of the list: no wording is needed."""
    plain = {"wording": C.Wording(), "code": None}
    listed = ["Germany", "United Kingdom", "United States", "Saudi Arabia", "France", "Vietnam", "New Zealand", "Côte d'Ivoire"]
    places = spark.createDataFrame(list(enumerate(listed, 1)), "place int, name string")
    asked = {"made in Germny": 1, "united kingdom (UK)": 2, "Untied States": 3, "Saudi-Arabia": 4, "Atlantis": None, "United": None, "France / Germany": None, "NEW ZEELAND": 7, "cote divoire": None, "cote d'ivoire": 8}
    df = spark.createDataFrame([*enumerate([*asked, "Vietnam", None, " "])], "id int, country string")
    got = {int(r.id): r.place for r in C.mapped_ids(df, places, "country", entry="place", **plain).collect()}
    assert got == dict(enumerate(asked.values()))
    parts = table(spark, "/root/testdata/sf0.001", "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("part"))
    held = {r.name: r.part for r in parts.collect()}
    typed = spark.createDataFrame([(p, n.upper().replace(" ", "-").replace("WIDGET", "widgte") + " (1 x)") for n, p in held.items()], "id long, value string")
    got = {int(r.id): r.part for r in C.mapped_ids(typed, parts, "value", entry="part", **plain).collect()}
    assert len(got) == len(held) > 40 and all(p == q for p, q in got.items())


def test_unmatched_are_reported(spark, entries):
    df = spark.createDataFrame([("1", "none"), ("2", "none"), ("3", "cc by 4")], "id string, license string")
    assert [tuple(r) for r in C.unmatched(df, entries).collect()] == [("none", 2)]
