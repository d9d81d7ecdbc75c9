"""Which engine a game is made with, from the listing of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The engines in the order in which ties are won, and the files that tell the two variants of the first.
ENGINES = ("rpgmaker", "renpy", "twine", "tyrano")
MZ_FILES, MV_FILES = ("js/rmmz_core.js", "www/js/rmmz_core.js", "game.rmmzproject"), ("js/rpg_core.js", "www/js/rpg_core.js", "Game.rpgproject")
ROOTS, STORY_TAG, STORY_BYTES = ("", "www/", "resources/app/"), "<tw-storydata", 64 << 20



def _when(rule: Column, weight: int) -> Column:
    return F.when(F.coalesce(rule, F.lit(False)), weight).otherwise(0)


def engine_weights(files: DataFrame) -> DataFrame:
    """game and a weight for each engine (0: it isn't one). files: game, path (from the game's folder, or within its archive), packed (within an ASAR archive), size, head (the first MiB of an HTML file, else null)."""
    path, packed = F.col("path"), F.coalesce("packed", F.lit(False))
    # Code beats project files, and a variant found in an archive beats the disk.
    core = lambda names: path.isin(*[n for n in names if n.endswith(".js")])
    rank = lambda inside: F.max(F.when(packed == inside, F.greatest(_when(core(MZ_FILES), 4), _when(core(MV_FILES), 3), _when(path.isin(*MZ_FILES), 2), _when(path.isin(*MV_FILES), 1))))
    in_game = path.startswith("game/")
    renpy = F.when(packed, 0).otherwise(F.greatest(_when(in_game & path.endswith(".rpy"), 80), _when(in_game & path.endswith(".rpyc"), 75), _when(in_game & F.lower(path).endswith(".rpa"), 70), _when(path.startswith("renpy/"), 60)))
    near = (F.size(F.split(path, "/")) <= 2) & F.lower(path).rlike(r"\.html?$") & (F.coalesce("size", F.lit(0)) <= STORY_BYTES)
    twine = F.when(~packed & near & F.contains("head", F.lit(STORY_TAG)), 60).otherwise(0)
    marks = []
    for root in ROOTS:
        under = lambda p, r=root: F.coalesce(F.bool_or(~packed & path.startswith(r + p)), F.lit(False))
        script = F.coalesce(F.bool_or(~packed & F.lower(path).rlike("^" + root + r"data/scenario/[^/]+\.ks$")), F.lit(False))
        marks.append(F.when(under("tyrano/") & under("data/scenario/"), 95).when(under("tyrano/"), 70).when(script, 80))
    out = files.groupBy("game").agg(rank(True).alias("inside"), rank(False).alias("outside"), F.coalesce(F.max(renpy), F.lit(0)).alias("renpy"), F.coalesce(F.max(twine), F.lit(0)).alias("twine"), F.coalesce(*marks, F.lit(0)).alias("tyrano"))
    mz = lambda c: F.col(c).isin(4, 2)
    found = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    rpg = F.when(found("inside"), F.when(mz("inside"), 110).otherwise(100)).when(found("outside"), F.when(mz("outside"), 100).otherwise(90)).otherwise(0)
    return out.select("game", rpg.alias("rpgmaker"), "renpy", "twine", "tyrano")


def detected_engine(files: DataFrame) -> DataFrame:
    """game, engine, weight: the engine of the highest weight, ties to the first of ENGINES; null and 0 if none has any."""
    ranked = F.array(*[F.struct(F.col(e).alias("weight"), F.lit(-k).alias("first"), F.lit(e).alias("engine")) for k, e in enumerate(ENGINES)])
    best = engine_weights(files).select("game", F.array_max(ranked).alias("b"))
    return best.select("game", F.when(F.col("b.weight") > 0, F.col("b.engine")).alias("engine"), F.col("b.weight").alias("weight"))
