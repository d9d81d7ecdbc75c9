"""What the engine is asked, in which batches and with which lines around, routes that must not reach it, and memories with repeated keys."""

import json
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from lexloom.operators import entries as E
from lexloom.operators import translate as T


def rows_of(spark, texts):
    return spark.createDataFrame([(i, "f", "p", "", t, "", "new") for i, t in enumerate(texts)], "id long, file string, json_path string, context string, original string, translation string, status string")


@pytest.fixture
def log(tmp_path):
    return str(tmp_path)


def noted(log):
    return sorted(x for f in os.listdir(log) for x in json.load(open(f"{log}/{f}")))


def counting(log, change):
    def ask(texts):
        if len(texts):
            json.dump([x for x in texts if x is not None], open(f"{log}/{uuid.uuid4().hex}", "w"))
        return texts.map(change)

    # The columns are asked for by batches of rows; a null would be a row that is none of the engine's business.
    def run(t: pd.Series) -> pd.Series:
        return ask(t)

    return lambda c: F.pandas_udf(run, PT.StringType())(c)


def test_each_text_is_asked_for_once(spark, log):
    texts = ["Hello there", "Hello there", "\\V[1]", "12 + 3", "img/day.png", "https://a.b/day", "A", "Keep [x.y] this", "Lose [x.y] this"]
    change = lambda t: "нет" if t.startswith("Lose") and "<x0/>" in t else "~" + t
    out = T.translate_entries(rows_of(spark, texts), "ru", counting(log, change)).collect()
    got = {r["id"]: r["translation"] for r in out}
    assert noted(log) == ["Hello there", "Keep <x0/> this", "Lose <x0/> this", "Lose [x.y] this"]
    assert got == {0: "~Hello there", 1: "~Hello there", 2: "", 3: "", 4: "img/day.png", 5: "https://a.b/day", 6: "A", 7: "~Keep [x.y] this", 8: "~Lose [x.y] this"}


def test_terms_do_not_break_addresses(spark, log):
    glossary = spark.createDataFrame([("en", "ru", "day", "день"), ("en", "ru", "Orb", "Сфера"), ("ja", "ru", "day", "x")], "src string, tgt string, term string, tr string")
    texts = ["img/day.png", "https://a.b/day", "a day of Orb", "one day of two day", "day", "no term"]
    out = T.translate_entries(rows_of(spark, texts), "ru", counting(log, lambda t: "~" + t), glossary=glossary).collect()
    assert [r["translation"] for r in sorted(out, key=lambda r: r["id"])] == ["img/day.png", "https://a.b/day", "a день ~of Сфера", "~one день ~of two день", "день", "~no term"]
    assert noted(log) == ["no term", "of", "of two", "one"]


def test_a_memory_with_repeated_keys(spark):
    memory = spark.createDataFrame([("Hi you", "en", "ru", "one", 1), ("Hi you", "en", "ru", "two", 2), ("Hi you", "ja", "ru", "three", 3)], "source string, src_lang string, tgt_lang string, target string, ord long")
    for m, want in ((memory, "two"), (memory.drop("ord"), "two")):
        out = T.translate_entries(rows_of(spark, ["Hi you", "Other", "Hi you"]), "ru", lambda c: F.concat(F.lit("~"), c), memory=m).collect()
        assert [r["translation"] for r in sorted(out, key=lambda r: r["id"])] == [want, "~Other", want]
        assert E.tm_lookup(rows_of(spark, ["Hi you", "Other"]), m, "en", "ru").count() == 2


def test_batches_with_context_and_failures(spark):
    texts = ["first line"] + [f"line number {k}" for k in range(8)] + ["first line", "это по-русски", "bad line"]

    def ask(texts, before, after):
        if "bad line" in texts and len(texts) == 1:
            raise RuntimeError
        return [f"{'/'.join(before)}|{t}|{'/'.join(after)}" for t in texts]

    out = T.translate_entries(rows_of(spark, texts), "ru", T.Batches(ask, lines=3, context=2)).collect()
    got = [r["translation"] for r in sorted(out, key=lambda r: r["id"])]
    assert got[0] == got[9] == "|first line|line number 2/line number 3"
    assert got[4] == "line number 0/line number 1|line number 3|line number 5/line number 6"
    assert got[11] == "bad line" and got[10] == ""
    lost = T.translate_entries(rows_of(spark, texts[:3]), "ru", T.Batches(lambda t, b, a: t[:-1])).collect()
    assert [r["translation"] for r in lost] == [r["original"] for r in lost]


def test_both_ways_to_match_terms(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "the Memory Orb shines"), (2, "orb"), (3, None), (4, "aaa"), (5, "")], "id int, t string")
    terms = spark.createDataFrame([("Orb",), ("Memory Orb",), ("aa",), ("a",), ("",), ("Orb",)], "term string")
    want = [(1, "Memory Orb"), (1, "Orb"), (4, "a"), (4, "aa")]
    assert sorted(map(tuple, E.glossary_matches(rows, terms.where("term in ('Orb', 'Memory Orb', 'aa')"), "id", "t").collect())) == [w for w in want if w[1] != "a"]
    found = sorted(map(tuple, E.glossary_matches(rows, terms, "id", "t").collect()))
    monkeypatch.setattr(E, "TERM_BYTES", 0)
    assert found == sorted(map(tuple, E.glossary_matches(rows, terms, "id", "t").collect()))
    assert set(want) <= set(found)
    assert E.glossary_matches(rows, terms.limit(0), "id", "t").collect() == []
