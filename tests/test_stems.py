from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.functions import stems as S
from lanternfish.functions.text import words

PAPER = "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll"


def test_examples_of_the_paper():
    assert {w: S.stem(w) for w, _ in (x.split(":") for x in PAPER.split())} == dict(x.split(":") for x in PAPER.split())
    assert S.stem("übungen") == "übungen" and S.stem("is") == "is" and S.stem("") == ""


def test_terms(spark):
    df = spark.createDataFrame([("The ponies of the operators", "A pony's operator"), (None, "x")], "a string, b string")
    got = df.select(S.index_terms(words(F.col("a"))).alias("a"), S.index_terms(words(F.col("b"))).alias("b"))
    assert [list(r.x) for r in got.select(S.shared_terms(F.col("a"), F.col("b")).alias("x")).collect()] == [["oper", "poni"], []]
