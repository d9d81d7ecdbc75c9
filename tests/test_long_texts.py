"""Expressions on texts of a megabyte: no stack is used up, and results are as on short ones."""

import time

from pyspark.sql import functions as F

from lexloom.functions import codes as C
from lexloom.functions import text as X
from lexloom.sources import markup as M

N = 1_000_000


def one(spark, *columns, **texts):
    row = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts))
    return row.select(*columns).collect()[0]


def test_groups_of_a_megabyte(spark):
    began = time.time()
    for long in ("[" + "a" * N + "]", "{" + "[x] " * (N // 4) + "}", "[" + '"' * N + "]", "[" * 20_000 + "1" + "]" * 20_000, "[" * 20_000 + "x"):
        r = one(spark, X.variables_safe(F.col("s"), F.col("t")), X.variables_safe(F.col("s"), F.col("u")), s=f"a {long}", t=f"c {long}", u=f"c {long[:-1]}")
        assert (r[0], r[1]) == (True, False)
    assert time.time() - began < 60


def test_groups_of_any_depth(spark):
    for text, want in (("a [b{c}] {d} e", ["[b{c}]", "{d}"]), ("[1[2[3[4[5[6]]]]]] x {y", ["[1[2[3[4[5[6]]]]]]", "{y"]), ("] [a", ["[a"]), ("[a}b]", ["[a}"]), ("", []), ("[[[[[[a]]]]] [b] c", ["[[[[[[a]]]]] [b] c"])):
        assert one(spark, X.outer_groups(F.col("t")), t=text)[0] == want


def test_fixers_on_long_groups(spark):
    long = "[" + "a1" * (N // 2) + "]"
    assert one(spark, C.fix_circled(F.col("s"), F.col("t")), s=f"① {long}", t=f"1 {long}")[0] == f"① {long}"
    assert one(spark, C.apply_fixers(F.col("s"), F.col("t"), "ru"), s=f"① {long}", t=f"1 {long}")[0].startswith("① [a1")


def test_masks_and_edges_of_many_codes(spark):
    began, many = time.time(), r"\C[1]\V[22]" * 10_000
    r = one(spark, C.mask_codes(F.col("t")), C.split_edges(F.col("t")), t=many + "x" + many)
    assert r[0]["masked"].startswith("<x0/><x1/>") and r[0]["masked"].endswith("<x39999/>") and len(r[0]["codes"]) == 40_000
    assert r[1]["middle"] == "x" and len(r[1]["lead"]) == len(r[1]["trail"]) == 20_000
    assert time.time() - began < 60


def test_scenario_tags_of_a_megabyte(spark):
    line = 'a[tag text="' + "]b" * (N // 2) + '"]c[' + "d" * N + "]e[open"
    got = one(spark, M.scenario_segments(F.col("t")), t=line)[0]
    assert [(s["kind"], len(s["raw"])) for s in got] == [("text", 1), ("tag", N + 13), ("text", 1), ("tag", N + 2), ("text", 6)]


def test_surplus_codes_without_a_mark_of_our_own(spark):
    r = one(spark, C.fix_codes(F.col("s"), F.col("t")), s="a [x.y] b", t="[x.y] a\x01b [x.y]")
    assert r[0] == " a\x01b [x.y]"


def test_variables_of_scenarios(spark):
    safe = X.scenario_variables_safe(F.col("s"), F.col("t"))
    assert [one(spark, safe, s=s, t=t)[0] for s, t in (("%player_name のターン", "%player_name ходит"), ("%player_name のターン", "ходит"), ("f.flag", "флаг"), ("&a.b %c", "%c &a.b"), ("plain", "x"))] == [True, False, False, False, True]


def test_sizes_and_numbers(spark):
    r = spark.sql("SELECT 1536L AS a, 3145728L AS b, 1073741824L AS c, 1234567L AS n, 'abc' AS t").select(X.size_text(F.col("a")), X.size_text(F.col("b")), X.size_text(F.col("c"), False), X.spaced_number(F.col("n")), X.short_md5(F.col("t"))).collect()[0]
    assert tuple(r) == ("0.0 МБ", "3.0 МБ", "1.00 GB", "1 234 567", "900150983cd2")
