"""Sentences, chunks, placeholders and quick paths of the offline translation; pieces joined give the text back."""

import random

from pyspark.sql import functions as F

from lexloom.operators import offline as O


def each(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [tuple(r)[1:] for r in df.select("id", *columns).orderBy("id").collect()]


def test_sentences(spark):
    texts = ["Hi. There! Mr. Smith came, etc. and so on. End", 'He said "No." Then left. (Yes!) Ok', "a\nb\n\nc. d", "No end", "3.14 is pi. e.g. this\nfig.\n x", "", "Dr. Who? Al. Co. end.", "… x… y"]
    got = [r[0] for r in each(spark, texts, O.sentences(F.col("t"), "en"))]
    assert ["".join(g) for g in got] == texts
    assert got[0] == ["Hi.", " There!", " Mr. Smith came, etc. and so on.", " End"]
    assert got[1] == ['He said "No."', " Then left.", " (Yes!)", " Ok"]
    assert got[2] == ["a\n", "b\n", "\n", "c.", " d"] and got[4] == ["3.14 is pi.", " e.g. this\n", "fig.\n x"]
    assert each(spark, ["はい。いいえ！「何？」\nえ"], O.sentences(F.col("t"), "ja")) == [(["はい。", "いいえ！", "「何？", "」\n", "え"],)]


def test_chunks(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bb,", "ccc.", "d"]) for _ in range(n)) + " " * (n % 3) for n in range(40)]
    for t, (pieces,) in zip(texts, each(spark, texts, O.chunks(F.col("t"), 6))):
        assert "".join(pieces) == t and all(len(p.split()) <= 6 for p in pieces)
    assert each(spark, ["a b c d, e f g h", "a b, c d e f g"], O.chunks(F.col("t"), 6)) == [(["a b c d,", " e f g h"],), (["a b, c d e f", " g"],)]


def test_small_functions(spark):
    latin = ["A", "HP", "No", "AA", "aaa", "Yes", "DDD", "HPX1", "", "Привет"]
    assert [r[0] for r in each(spark, latin, O.transliterated(F.col("t"), "ru"))] == ["А", "ХП", None, "АА", "ааа", None, "ДДД", None, None, None]
    assert [r[0] for r in each(spark, ["x", "7", "!", " ", "ホ", "Б", "家", "ab", "☆"], O.is_single_mark(F.col("t")))] == [True, True, True, True, True, True, False, False, True]
    assert [r[0] for r in each(spark, ["Ａ\u200bＢ  \t c\x07", "ｶﾞ", None], O.normalised(F.col("t")))] == ["AB c", "ガ", None]
    pairs = [("Хорошо.", "OK"), ("В)", "C"), ("Да , это так .", "Yes"), ("Да, так.", "Yes, it is"), ("Да.", "Yes."), ("(а)", "ab")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t string, s string")
    assert [r[0] for r in df.orderBy("i").select(O.trimmed(F.col("t"), F.col("s"))).collect()] == ["Хорошо", "В", "Да, это так", "Да, так.", "Да.", "(а)"]


def test_offline_translation(spark):
    glossary = {"Memory Orb": "Сфера памяти", "orb": "сфера", "魔女": "ведьма", "same": "same", "?!": "x"}
    texts = ["A", "HP", "", None, "!", "The memory orb glows. An ORB, orbit \\V[1] end.", "Same piece. Same piece.", "12 + 3 = 15", "{name} says <b>hello</b>", "word " * 20]
    out = O.offline_translations(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, original string"), lambda c: F.concat(F.lit("я"), F.translate(c, "abcdefghijklmnoprstuvwxyz", "абцдефгхийклмнопрстуввхыз")), "en", "ru", glossary, most=8)
    got = {r["id"]: r["text"] for r in out.collect()}
    assert got[0] == "А" and got[1] == "ХП" and got[2] == "" and got[3] is None and got[4] == "!"
    assert got[5].count("Сфера памяти") == 1 and got[5].count("сфера") == 1 and "\\V[1]" in got[5] and "орбит" in got[5]
    assert got[6].count("я") == 2 and got[7] == "12 + 3 = 15" and "{name}" in got[8] and "<b>" in got[8] and "</b>" in got[8]
    assert got[9] == "word " * 20  # repeated stems look made up


def test_a_repeated_piece_is_asked_once(spark):
    rows = spark.createDataFrame([(i, f"One line. Two lines {i % 2}.") for i in range(20)], "id int, original string")
    seen = spark.sparkContext.accumulator(0)

    def count(s):
        seen.add(len(s))
        return s.map(lambda t: "э" + t)

    from pyspark.sql import types as PT
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        return count(s)

    out = O.offline_translations(rows, lambda c: F.pandas_udf(run, PT.StringType())(c), "en", "xx").collect()
    assert len(out) == 20 and seen.value == 3 and {r["text"] for r in out} == {"эOne line.э Two lines 0.", "эOne line.э Two lines 1."}
