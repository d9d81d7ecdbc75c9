"""Scan of a game's data files, told apart by their names. A file is a row: file, body (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.shared import dealt
from lexloom.sources import game_json as J

#: The fields with text of each database, and those of the system file.
FIELDS = {
    "Actors.json": ["name", "nickname", "profile"],
    "Classes.json": ["name"],
    "Items.json": ["name", "description"],
    "Weapons.json": ["name", "description"],
    "Armors.json": ["name", "description"],
    "Enemies.json": ["name"],
    "Skills.json": ["name", "description", "message1", "message2"],
    "States.json": ["name", "message1", "message2", "message3", "message4"],
    "Animations.json": ["name"],
    "Tilesets.json": ["name"],
}
SYSTEM_LISTS = ["skillTypes", "armorTypes", "weaponTypes", "elements", "equipTypes"]
TERM_LISTS = ["basic", "commands", "params"]
#: Members that hold no text, levels looked into below a record's own field and in an unknown file.
NO_TEXT = ["note", "meta", "traits", "effects", "damage"]
RECORD_LEVELS, FILE_LEVELS = 4, 6

_FOUND = "array<struct<json_path:string,context:string,original:string>>"
_PAGES = "array<struct<name:string,pages:array<struct<list:string>>>>"
_LISTS = "array<struct<base:string,about:string,list:string>>"


def _text(*parts: Column | str) -> Column:
    """The parts one after another; a string is itself, not a column."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _found(path: Column, context: Column, original: Column) -> Column:
    return F.struct(path.alias("json_path"), context.alias("context"), original.alias("original"))


def _list(base: Column, about: Column, commands: Column) -> Column:
    return F.struct(base.alias("base"), about.alias("about"), commands.alias("list"))


def _kind(name: Column) -> Column:
    other = {"MapInfos.json": "names", "CommonEvents.json": "common", "Troops.json": "troops", "System.json": "system"}
    rule = F.when(name.isin(*FIELDS), "records")
    for file, kind in other.items():
        rule = rule.when(name == file, kind)
    return rule.when(name.startswith("Map"), "map").otherwise("other")


def named_files(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """file, body, name, stem, kind, data (null: not JSON)."""
    name = F.element_at(F.split("file", "/"), -1)
    rows = dealt(files.select(F.col(file).alias("file"), F.col(body).alias("body")), "file", "body").withColumn("name", name)
    return rows.where(F.col("name").endswith(".json")).withColumn("stem", F.regexp_replace("name", r"\.json$", "")).withColumn("kind", _kind(F.col("name"))).withColumn("data", F.try_parse_json("body"))


def rejected_files(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """The files that aren't JSON."""
    return named_files(files, file, body).where("data IS NULL").select("file")


def _record_texts() -> Column:
    every = sorted({f for fields in FIELDS.values() for f in fields})
    own = F.create_map(*[x for k, v in FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("name")]
    records = F.from_json("body", "array<struct<" + ",".join(f"{f}:string" for f in every) + ">>")

    def texts(r: Column, i: Column) -> Column:
        called = F.when(F.length(r["name"]) > 0, r["name"]).otherwise(_text("#", i))
        value = F.create_map(*[x for f in every for x in (F.lit(f), r[f])])
        return F.transform(own, lambda f: _found(_text("[", i, "].", f), _text(F.col("stem"), " '", called, "'"), value[f]))

    return F.flatten(F.transform(records, texts))


def _map_texts() -> Column:
    data = F.from_json("body", f"struct<displayName:string,events:{_PAGES}>")
    events = F.transform(data["events"], lambda e, i: _found(_text("events[", i, "].name"), _text(F.col("stem"), " event name"), e["name"]))
    return F.concat(F.array(_found(F.lit("displayName"), F.lit("map name"), data["displayName"])), F.coalesce(events, F.array().cast(_FOUND)))


def _names(context) -> Column:
    records = F.from_json("body", "array<struct<name:string>>")
    return F.transform(records, lambda r, i: _found(_text("[", i, "].name"), context(i), r["name"]))


def _system_texts() -> Column:
    lists = SYSTEM_LISTS + ["variables", "switches"]
    terms = ",".join(f"{t}:array<string>" for t in TERM_LISTS) + ",messages:map<string,string>"
    data = F.from_json("body", "struct<gameTitle:string,currencyUnit:string," + ",".join(f"{f}:array<string>" for f in lists) + f",terms:struct<{terms}>>")
    none = F.array().cast(_FOUND)

    def numbered(values: Column, path: str, context) -> Column:
        return F.coalesce(F.transform(values, lambda v, i: _found(_text(path, "[", i, "]"), context(i), v)), none)

    parts = [F.array(_found(F.lit("gameTitle"), F.lit("game title"), data["gameTitle"]), _found(F.lit("currencyUnit"), F.lit("currency"), data["currencyUnit"]))]
    parts += [numbered(data[f], f, lambda i, f=f: F.lit(f"term {f}")) for f in SYSTEM_LISTS]
    parts += [numbered(data[f], f, lambda i, f=f: _text(f"{f[:-2] if f == 'switches' else f[:-1]} #", i)) for f in ("variables", "switches")]
    parts += [numbered(data["terms"][t], f"terms.{t}", lambda i, t=t: F.lit(f"term {t}")) for t in TERM_LISTS]
    said = F.transform(F.map_entries(data["terms"]["messages"]), lambda m: _found(_text("terms.messages.", m["key"]), F.lit("system message"), m["value"]))
    return F.concat(*parts, F.coalesce(said, none))


def field_texts(named: DataFrame) -> DataFrame:
    """file, json_path, context, original: fields of known files, all from one pass over them."""
    kind = F.col("kind")
    found = F.when(kind == "records", _record_texts()).when(kind == "map", _map_texts()).when(kind == "system", _system_texts())
    found = found.when(kind == "common", _names(lambda i: _text("common event #", i))).when(kind == "troops", _names(lambda i: _text("enemy group #", i))).when(kind == "names", _names(lambda i: F.lit("map name (list)")))
    rows = named.where((kind != "other") & F.col("data").isNotNull())
    return rows.select("file", F.inline(found)).where(~X.is_blank(F.col("original")))


def command_lists(named: DataFrame) -> DataFrame:
    """file, base, about, list: the event commands of maps, common events and troops, one row for each list."""
    kind, none = F.col("kind"), F.array().cast(_LISTS)

    def paged(events: Column, prefix: str, about) -> Column:
        each = lambda e, i: F.coalesce(F.transform(e["pages"], lambda p, k: _list(_text(prefix, "[", i, "].pages[", k, "].list"), about(F.coalesce(e["name"], i.cast("string")), k + 1), p["list"])), none)
        return F.flatten(F.transform(events, each))

    maps = paged(F.from_json("body", f"struct<events:{_PAGES}>")["events"], "events", lambda n, k: _text(F.col("stem"), " event '", n, "' p.", k))
    troops = paged(F.from_json("body", _PAGES), "", lambda n, k: _text("battle '", n, "' p.", k))
    common = F.transform(F.from_json("body", "array<struct<name:string,list:string>>"), lambda e, i: _list(_text("[", i, "].list"), _text("common event '", F.coalesce(e["name"], i.cast("string")), "'"), e["list"]))
    rows = named.where(kind.isin("map", "troops", "common") & F.col("data").isNotNull())
    return rows.select("file", F.inline(F.when(kind == "map", maps).when(kind == "troops", troops).otherwise(common))).where("list IS NOT NULL")


def event_texts(named: DataFrame) -> DataFrame:
    lists = command_lists(named).select(F.struct("file", "base", "about").alias("owner"), "list")
    out = J.command_texts(lists, file="owner", body="list")
    return out.select("owner.file", F.concat("owner.base", "json_path").alias("json_path"), F.concat("owner.about", F.lit(" / "), "context").alias("context"), "original")


def _plain(text: Column) -> Column:
    """Whether a string of an unknown place is text."""
    s = F.trim(text)
    cjk = (F.length(s) <= 600) & s.rlike(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]")
    return (s != "") & (cjk | J.js_text(s))


def unknown_texts(named: DataFrame) -> DataFrame:
    """Texts of records' other fields and of files with another name, at any place down to a number of levels.

    Members that hold no text are skipped in records and in objects that stand within objects only, not below a list.
    """
    top = named.where(F.col("kind").isin("records", "other") & F.col("data").isNotNull()).select("file", "name", "stem", "kind", F.explode(J._members(F.col("data"))).alias("m"))
    listed = F.col("m.step").startswith("[")
    number = F.regexp_extract("m.step", r"\d+", 0)
    record = F.try_variant_get("m.v", "$", "map<string,variant>")
    known = F.create_map(*[x for k, v in FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("name")]
    called = F.coalesce(F.nullif(F.try_variant_get("m.v", "$.name", "string"), F.lit("")), number)
    # Of records: their other members, under the record's path.
    records = top.where((F.col("kind") == "records") & listed).select("file", F.col("m.step").alias("at"), F.concat("stem", F.lit(" '"), called, F.lit("' / ")).alias("about"), known.alias("known"), F.explode(record).alias("k", "v"))
    records = records.where(~F.array_contains("known", F.col("k"))).select("file", "k", F.concat("at", F.lit("."), "k").alias("path"), F.concat("about", "k").alias("context"), "v", F.lit(False).alias("inside"), F.lit(0).alias("depth"))
    # Of other files: an object's members, or what stands in a list.
    context = F.concat(F.lit("file "), "name", F.when(listed, F.concat(F.lit(" #"), number)).otherwise(""))
    key = F.when(~listed, F.substring("m.step", F.lit(2), F.length("m.step")))
    loose = top.where("kind = 'other'").select("file", key.alias("k"), F.coalesce(key, F.col("m.step")).alias("path"), context.alias("context"), F.col("m.v").alias("v"), F.lit(True).alias("inside"), F.when(listed, -1).otherwise(0).alias("depth"), listed.alias("listed"))
    # A list within a list of a file isn't looked into.
    loose = loose.where(~F.col("listed") | ~F.schema_of_variant("v").startswith("ARRAY")).drop("listed")
    level = records.unionByName(loose).where(F.col("k").isNull() | ~F.col("k").isin(*NO_TEXT))
    for _ in range(FILE_LEVELS + RECORD_LEVELS):
        level = level.select("file", "path", "context", "inside", "depth", F.schema_of_variant("v").startswith("ARRAY").alias("of_list"), F.explode(J._opened(F.col("v"))).alias("m"))
        shut = F.col("m.step") == ""
        # Below a list the count of levels starts again.
        inside = F.col("inside") & (shut | ~F.col("of_list"))
        depth = F.when(shut, F.col("depth")).when(F.col("inside") & F.col("of_list"), 1).otherwise(F.col("depth") + 1)
        member = F.when(~shut & ~F.col("of_list"), F.substring("m.step", F.lit(2), F.length("m.step")))
        level = level.select("file", member.alias("k"), F.concat("path", "m.step").alias("path"), "context", F.col("m.v").alias("v"), inside.alias("inside"), depth.alias("depth"))
        level = level.where((F.col("depth") <= F.when(F.col("inside"), FILE_LEVELS).otherwise(RECORD_LEVELS)) & (F.col("k").isNull() | ~F.col("inside") | ~F.col("k").isin(*NO_TEXT)))
    out = level.withColumn("original", J._string(F.col("v"))).where(_plain(F.col("original")))
    return out.select("file", F.col("path").alias("json_path"), "context", "original")


def game_texts(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """file, json_path, context, original: every text of a game's data files. A path of a file is given once."""
    named = named_files(files, file, body)
    return field_texts(named).unionByName(event_texts(named)).unionByName(unknown_texts(named)).dropDuplicates(["file", "json_path"])
