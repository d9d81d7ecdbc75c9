"""Answers of language models in all their forms."""

from pyspark.sql import functions as F

from lexloom.functions import answers as A


def test_translations(spark):
    cases = [
        ('["a", "b"]', 2, ["a", "b"]), ('Sure:\n```json\n["a", "b [x]"]\n```', 2, ["a", "b [x]"]), ('["a"]', 2, None), ("", 1, None), (None, 1, None), ("[1, true]", 2, ["1", "true"]),
        ('{"i": 1, "t": "b"},\n{"i": 0, "t": "a"}', 2, ["a", "b"]), ('{"i": 0, "t": "a"}\nnoise\n{"i": 0, "t": "c"}\n{"i":1,"t":"b"}', 2, ["c", "b"]), ('{"i": 0, "t": "a"}', 2, None), ('{"i": 0, "t": 5}\n{"i": 1, "t": "x"}', 2, ['{"i":0,"t":5}', '{"i":1,"t":"x"}']),
        ('"first"\n"second [1]"', 2, ["first", "second [1]"]), ('"first"\nsecond', 2, None), ("plain", 1, None), ('{"i": 0, "t": "a"}\n{"i": 2, "t": "b"}\nx', 2, None),
    ]
    df = spark.createDataFrame([(k, c, n) for k, (c, n, _) in enumerate(cases)], "k int, c string, n int")
    got = {r["k"]: r["out"] for r in df.select("k", A.translations_of(F.col("c"), F.col("n")).alias("out")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, _, w in cases]


def test_terms(spark):
    cases = [('Here: [{"term": "Orb", "trans": "Сфера"}, {"trans": "x"}, {"term": "Day"}]', [("Orb", "Сфера"), ("Day", "")]), ('{"term": "A", "trans": "Б"},\nnoise\n{"term": "", "trans": "x"}', [("A", "Б")]), ("nothing", []), (None, [])]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, c string")
    got = {r["k"]: [tuple(t) for t in r["out"]] for r in df.select("k", A.terms_of(F.col("c")).alias("out")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]
