"""Weights of engines by a game's files."""

from lexloom.operators import engines as G


def test_engines(spark):
    games = {
        "mz": (["js/rmmz_core.js", "data/Map001.json"], "rpgmaker", 100), "mv": (["www/js/rpg_core.js"], "rpgmaker", 90), "project": (["Game.rpgproject"], "rpgmaker", 90), "both": (["js/rpg_core.js", "game.rmmzproject"], "rpgmaker", 90),
        "asar-mz": ([("js/rmmz_core.js", True), "js/rpg_core.js"], "rpgmaker", 110), "asar-mv": ([("js/rpg_core.js", True)], "rpgmaker", 100),
        "rpy": (["game/x/a.rpyc", "game/a.rpy"], "renpy", 80), "rpyc": (["game/a.rpyc", "game/b.RPA"], "renpy", 75), "rpa": (["game/b.RPA"], "renpy", 70), "renpy": (["renpy/x.py"], "renpy", 60),
        "story": ([("index.html", None, '<p><tw-storydata name="x">')], "twine", 60), "deep story": ([("a/b/index.html", None, "<tw-storydata>")], None, 0), "page": ([("index.html", None, "<p>")], None, 0),
        "tyrano": (["tyrano/t.js", "data/scenario/a.ks"], "tyrano", 95), "scenario": (["www/data/scenario/A.KS"], "tyrano", 80), "bare": (["resources/app/tyrano/x.js"], "tyrano", 70), "none": (["readme.txt", None], None, 0),
        "tie": (["renpy/x.py", ("a.htm", False, "<tw-storydata>")], "renpy", 60),
    }
    rows = []
    for game, (files, _, _) in games.items():
        for f in files:
            path, packed, head = (*f, None)[:3] if isinstance(f, tuple) else (f, False, None)
            rows.append((game, path, packed, 100, head))
    got = {r["game"]: (r["engine"], r["weight"]) for r in G.detected_engine(spark.createDataFrame(rows, "game string, path string, packed boolean, size long, head string")).collect()}
    assert got == {g: (e, w) for g, (_, e, w) in games.items()}
