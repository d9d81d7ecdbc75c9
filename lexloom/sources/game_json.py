"""Scan of game databases in JSON: fields of records, and event commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.shared import dealt

#: Codes of commands that show text, and how their parameters hold it.
TEXT_CODES = {401: "dialog", 405: "dialog", 402: "branch", 108: "comment", 408: "comment", 320: "rename", 324: "rename"}
CHOICES = 102
SCRIPT = (355, 655)
#: A comment of a script, or (group 1) a string literal; what a literal of text doesn't begin with; levels of an unknown parameter.
JS_STRING = r"""//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|("[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+')"""
NOT_BEGUN, LEVELS = "^(?:http|www\\.|[=:<])", 5
_TYPED = "array<struct<code:int,parameters:array<variant>>>"
_COMMANDS = "array<struct<code:int,indent:int,parameters:array<string>>>"


def record_fields(files: DataFrame, fields: list[str], file: str = "file", body: str = "body") -> DataFrame:
    """file, json_path, original: `[i].field` of a list of records; what isn't such a list gives nothing."""
    kind = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
    rows = files.select(file, F.posexplode(F.from_json(body, kind)).alias("i", "r"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col("r")[f].alias("original")) for f in fields])
    out = rows.select(file, "i", F.inline(pairs))
    return out.where(~X.is_blank(F.col("original"))).select(file, F.concat(F.lit("["), "i", F.lit("]."), "field").alias("json_path"), "original")


def command_texts(files: DataFrame, base: str = "", file: str = "file", body: str = "body") -> DataFrame:
    """file, json_path, context, original: texts of a list of event commands, choices one by one."""
    rows = files.select(file, F.posexplode(F.from_json(body, _COMMANDS)).alias("i", "c")).select(file, "i", "c.*")
    kinds = F.create_map(*[F.lit(x) for kv in TEXT_CODES.items() for x in kv])
    at = F.concat(F.lit(base), F.lit("["), "i", F.lit("].parameters[0]"))
    plain = rows.where(F.col("code").isin(*TEXT_CODES)).select(file, at.alias("json_path"), kinds[F.col("code")].alias("context"), F.get("parameters", F.when(F.col("code").isin(402, 320, 324), 1).otherwise(0)).alias("original"), "code")
    plain = plain.withColumn("json_path", F.when(F.col("code").isin(402, 320, 324), F.regexp_replace("json_path", r"\[0\]$", "[1]")).otherwise(F.col("json_path"))).drop("code")
    listed = rows.where(F.col("code") == CHOICES).select(file, at.alias("at"), F.posexplode(F.from_json(F.get("parameters", F.lit(0)), "array<string>")).alias("k", "original"))
    choices = listed.select(file, F.concat("at", F.lit("["), "k", F.lit("]")).alias("json_path"), F.lit("choice").alias("context"), "original")
    return plain.unionByName(choices).unionByName(_typed_texts(files, base, file, body)).where(~X.is_blank(F.col("original")))


def js_text(s: Column) -> Column:
    """Whether a literal is text, not a key or a path."""
    cjk = s.rlike(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]")
    return F.length(s).between(2, 400) & X.has_letter(s) & (cjk | (s.rlike(r"\s") & ~s.rlike(r"[\\/]") & ~s.rlike(NOT_BEGUN)))


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _members(v: Column) -> Column:
    """array(struct(step, v)): of a list or an object what it holds, else null."""
    # Of a value of another kind these give null; its whole schema need not be read for that.
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, j: F.struct(F.concat(F.lit("["), j.cast("string"), F.lit("]")).alias("step"), x.alias("v")))
    named = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), e["value"].alias("v")))
    return F.coalesce(listed, named)


def _opened(v: Column) -> Column:
    """What a list or an object holds, else the value itself with an empty step: levels one after another need one pass. Empty ones give nothing."""
    return F.coalesce(_members(v), F.array(F.struct(F.lit("").alias("step"), v.alias("v"))))


def _typed_texts(files: DataFrame, base: str, file: str, body: str) -> DataFrame:
    """Speaker names, plugin texts, string literals of scripts, and texts at any place in the parameters of other commands."""
    rows = files.select(file, F.posexplode(F.from_json(body, _TYPED)).alias("i", "c")).select(file, "i", "c.*")
    code, many = F.col("code"), F.size(F.coalesce("parameters", F.array().cast("array<variant>")))
    rows = rows.withColumn("at", F.concat(F.lit(base), F.lit("["), "i", F.lit("].parameters")))
    param = lambda k: F.get("parameters", F.lit(k))

    def one(of: int, k: int, context: str) -> DataFrame:
        return rows.where((code == of) & (many > k)).select(file, F.concat("at", F.lit(f"[{k}]")).alias("json_path"), F.lit(context).alias("context"), _string(param(k)).alias("original"))

    plugin = rows.where((code == 357) & (many > 3)).select(file, "at", F.explode(_members(param(3))).alias("m"))
    plugin = plugin.select(file, F.concat("at", F.lit("[3]"), "m.step").alias("json_path"), F.lit("plugin").alias("context"), _string(F.col("m.v")).alias("original"))
    each = rows.select(file, "at", "code", "parameters", F.posexplode("parameters").alias("j", "v")).withColumn("path", F.concat("at", F.lit("["), "j", F.lit("]")))
    more = each.where(code == 657).select(file, F.col("path").alias("json_path"), F.lit("plugin").alias("context"), _string(F.col("v")).alias("original"))
    found = F.filter(F.regexp_extract_all(_string(param(0)), F.lit(JS_STRING), F.lit(1)), lambda x: x != "")
    literals = F.filter(F.transform(found, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), js_text)
    script = rows.where(code.isin(*SCRIPT)).select(file, "at", F.posexplode(literals).alias("k", "original"))
    script = script.select(file, F.concat("at", F.lit("[0]#script:"), "k").alias("json_path"), F.lit("script").alias("context"), "original")
    # A known command that lacks the parameter in question counts as unknown.
    known = code.isin(401, 405, 108, 408, 657) | ((code == CHOICES) & F.schema_of_variant(param(0)).startswith("ARRAY")) | (code.isin(402, 320, 324) & (many > 1)) | ((code == 101) & (many > 4)) | ((code == 357) & (many > 3)) | code.isin(356, *SCRIPT)
    level = each.where(~F.coalesce(known, F.lit(False))).select(file, "path", "code", "v")
    out = one(101, 4, "speaker name").unionByName(one(356, 0, "plugin (MV)")).unionByName(plugin).unionByName(more).unionByName(script)
    for _ in range(LEVELS - 1):
        level = level.select(file, "path", "code", F.explode(_opened(F.col("v"))).alias("m")).select(file, F.concat("path", "m.step").alias("path"), "code", F.col("m.v").alias("v"))
    texts = level.withColumn("original", _string(F.col("v"))).where(js_text(F.trim("original")) | (F.length(F.trim("original")) <= 600) & F.trim("original").rlike(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"))
    out = out.unionByName(texts.select(file, F.col("path").alias("json_path"), F.concat_ws(" ", F.lit("param"), F.col("code").cast("string")).alias("context"), "original"))
    return out


def path_keys(path: Column) -> Column:
    """The keys of a path such as events[3].pages[0].x, in order."""
    return F.regexp_extract_all(path, F.lit(r"([^.\[\]]+)"), F.lit(1))


def flat_variables(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, name, value: the top-level members of a JSON object."""
    return rows.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("name", "value"))


def flat_paths(rows: DataFrame, key: str, json: str, levels: int = 12) -> DataFrame:
    """key, path, value: every value of a nested document (`a.b`, `f[1].x`); empty lists and objects are `[]` and `{}`.

    One pass: each level opens what the one before left closed. What lies deeper is given as JSON text. A document that isn't
    JSON, or neither an object nor a list, gives nothing.
    """
    v = F.try_parse_json(json)
    # Short documents of a small file hold much work for one task.
    level = dealt(rows.select(key, json), key, json).select(key, F.lit("").alias("path"), v.alias("v")).where(_members(F.col("v")).isNotNull())
    for _ in range(levels):
        inside = F.get(F.filter(F.array(_members(F.col("v"))), lambda m: F.size(m) > 0), F.lit(0))
        as_is = F.array(F.struct(F.lit("").alias("step"), F.col("v").alias("v")))
        level = level.select(key, "path", F.explode(F.coalesce(inside, as_is)).alias("m")).select(key, F.concat("path", "m.step").alias("path"), "m.v")
    return level.select(key, F.regexp_replace("path", r"^\.", "").alias("path"), F.when(~F.is_variant_null("v"), F.col("v").cast("string")).alias("value"))
