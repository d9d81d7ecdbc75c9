"""Script sources: golden texts and hints, blocks, dialogues over several lines, languages, broken Python."""

import time

from pyspark.sql import functions as F

from lexloom.sources import scripts as R

SCRIPT = '''define e = Character("Айра")
label start:
    e "Привет, я ведьма."
    "Повествование без имени."
    $ x = _("Явная строка")
    # "comment"
    jump ending
    menu:
        "Первый выбор":
            pass
        "Второй выбор" :
            pass
    e "Первая строка
        вторая строка"
    e "escaped \\" quote" with fade
translate russian strings:
    old "Old text"
    new "New text"
'''
CODE = '''define quest_desc = "Найди меч в пещере"
default gold_text = "Золото: {gold}"
init -1 python:
    quests = {
        "q1": "Победи дракона",
        "quest_1": "Спаси принцессу из башни",
    }

    renpy.notify("Квест принят")
    name = renpy.input("Как тебя зовут?")
    hp_text = f"HP: {hp}"
    logo = "images/logo.png"
    url = "https://example.com"
    color = "#ff8800"
    token = "empty_token_small"
    count = 42
    def helper():
        """A secret docstring"""
        return "Из функции"
    class Box:
        "Another docstring"
        title = "Ящик"
$ renpy.notify("Выбор сделан")
python hide:
    print "Python two", 'don\\'t stop' # 'not this'
label end:
    "После блока"
'''


def texts(spark, *files):
    return R.script_entries(spark.createDataFrame(list(files), "file string, body string")).orderBy("file", "ord").collect()


def test_dialogue(spark):
    rows = texts(spark, ("game/a.rpy", SCRIPT), ("game/b.rpy", None))
    assert [r["original"] for r in rows] == ["Айра", "Привет, я ведьма.", "Повествование без имени.", "Явная строка", "Первый выбор", "Второй выбор", "Первая строка\n        вторая строка", 'escaped \\" quote', "Old text"]
    context = {r["original"]: r["context"] for r in rows}
    assert context["Первый выбор"] == "game/a.rpy:9:choice" and context["Old text"] == "game/a.rpy:17:translate-block"
    assert context["Явная строка"] == "game/a.rpy:python:x"


def test_python(spark):
    rows = texts(spark, ("s.rpy", CODE))
    hints = {r["original"]: r["context"].removeprefix("s.rpy:python").lstrip(":") for r in rows}
    assert hints == {
        "Найди меч в пещере": "quest_desc", "Золото: {gold}": "gold_text", "Победи дракона": "key=q1", "Спаси принцессу из башни": "key=quest_1", "Квест принят": 'renpy.notify("Квест принят")',
        "Как тебя зовут?": "name", "HP: {hp}": "hp_text", "Из функции": 'return "Из функции"', "Ящик": "title", "Выбор сделан": 'renpy.notify("Выбор сделан")',
        "Python two": "", "don\\'t stop": "", "После блока": "s.rpy:27:dialogue",
    }


def test_first_of_equal_texts(spark):
    rows = texts(spark, ("b.rpy", 'e "Same text"\ne "Own text"'), ("a.rpy", 'x "Other"\ne "Same text"'))
    assert [(r["file"], r["original"]) for r in rows] == [("a.rpy", "Other"), ("a.rpy", "Same text"), ("b.rpy", "Own text")]


def test_files_and_languages(spark):
    names = ["game/a.rpy", "game/tl/french/a.rpy", "game/tl/english/a.rpyc", "game/tl/english/a.rpy", "game/tl/.git/a.rpy", "game/own_x.rpy", "renpy/common/x.rpy", "game/a.png"]
    files = spark.createDataFrame([(n,) for n in names], "file string")
    assert sorted(r["file"] for r in R.script_files(files).collect()) == ["game/a.rpy", "game/tl/.git/a.rpy", "game/tl/english/a.rpy", "game/tl/french/a.rpy"]
    assert sorted(r["file"] for r in R.script_files(files, "french").collect()) == ["game/a.rpy", "game/tl/french/a.rpy"]
    assert [r["lang"] for r in R.script_languages(files).orderBy("lang").collect()] == ["english", "french"]


def test_literal_text(spark):
    good = ["Hi", "Текст", "a b", "short_x", "C: done.", "x" * 11]
    bad = ["", "x", "123", "a://b", "file:x y", "a.PNG ", "#ffaa00", "q1", "empty_token", "x" * 12, "uniform vec4", "a;\nb", "?!", "y " * 2500]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", R.is_literal_text(F.col("t")).alias("ok")).collect()
    assert [r["t"] for r in rows if r["ok"]] == good


def test_long_and_broken(spark):
    n = 300_000
    bodies = ['e "' + "a" * n, '"' + '\\"' * n, "python:\n    x = " + "(" * n, 'python:\n    x = "' + "b\\" * n, "e " * n, 'e "open\n' * 2000, "$ x = " + "+".join(['"t t"'] * 3000)]
    began = time.time()
    rows = texts(spark, *[(f"{k}.rpy", b + '\nlabel z:\n    "after"\n' + f'    "own {k}"') for k, b in enumerate(bodies)])
    found = {r["original"] for r in rows}
    assert {"own 2", "own 4", "own 6", "t t"} <= found and time.time() - began < 60
