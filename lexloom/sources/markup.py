"""Scans of HTML pages and of scenario lines with tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X

#: What isn't text of a page, and a tag of a scenario line (quotes may hold a closing bracket).
NO_TEXT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
SCENARIO_TAG = r"""\[(?:[^\]"']++|"[^"]*+"|'[^']*+')*+\]"""
SCRIPT_BLOCK, LONGEST_LINE = r"(?s)\[iscript\].*?(?:\[endscript\]|\z)", 4000
#: Tags whose attribute text is shown, and an attribute's name and value.
TEXT_TAG, ATTRIBUTE = r"^\[/?(?:link|button|ruby)(?![\w-])", r"""([A-Za-z_:][\w:.-]*)\s*=\s*("[^"]*"|'[^']*')"""


def html_segments(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, seg, original: the text between tags, in order, scripts, styles and comments left out; entities stay."""
    bare = F.regexp_replace(F.col(html), NO_TEXT, "<>")
    parts = pages.select(key, F.posexplode(F.split(bare, "<[^>]*>")).alias("seg", "raw"))
    return parts.select(key, "seg", X.stripped(F.col("raw")).alias("original")).where((F.col("original") != "") & X.has_letter(F.col("original")))


def scenario_segments(line: Column) -> Column:
    """array(struct(seg, kind, raw)): tags and the texts between them, in order."""
    tags = F.regexp_extract_all(line, F.lit(SCENARIO_TAG), F.lit(0))
    texts = F.split(line, SCENARIO_TAG, -1)
    pairs = F.flatten(F.zip_with(texts, tags, lambda t, g: F.array(F.struct(F.lit("text").alias("kind"), t.alias("raw")), F.struct(F.lit("tag").alias("kind"), g.alias("raw")))))
    kept = F.filter(pairs, lambda p: F.coalesce(p["raw"], F.lit("")) != "")
    return F.transform(kept, lambda p, i: F.struct(i.alias("seg"), p["kind"].alias("kind"), p["raw"].alias("raw")))


def tag_text(tag: Column) -> Column:
    """The attribute text (the last, if several) of a tag that shows it, else null."""
    names, values = (F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    own = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda a: a["name"] == "text")
    value = F.get(F.reverse(own), F.lit(0))["value"]
    return F.when(tag.rlike(TEXT_TAG), F.substring(value, F.lit(2), F.length(value) - 2))


def scenario_entries(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """file, line (from 1), seg, original: texts of scenario files, and those that link, button and ruby tags show; blank and very long lines, comments (;), labels (*) and script blocks are skipped.

    A script block is replaced by its line ends, so that the lines after it keep their numbers.
    """
    blocks, parts = F.regexp_extract_all(F.col(body), F.lit(SCRIPT_BLOCK), F.lit(0)), F.split(F.col(body), SCRIPT_BLOCK, -1)
    ends = F.transform(blocks, lambda b: F.regexp_replace(b, r"[^\n]", ""))
    shown = F.array_join(F.zip_with(parts, ends, lambda p, e: F.concat(F.coalesce(p, F.lit("")), F.coalesce(e, F.lit("")))), "")
    lines = F.transform(F.split(shown, r"\r?\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("raw")))
    good = F.filter(lines, lambda z: ~X.is_blank(z["raw"]) & (F.length(z["raw"]) <= LONGEST_LINE) & ~X.stripped(z["raw"]).rlike("^[;*]"))
    out = files.select(file, F.explode(good).alias("l")).select(file, "l.line", F.inline(scenario_segments(F.col("l.raw"))))
    text = F.when(F.col("kind") == "text", F.col("raw")).otherwise(tag_text(F.col("raw")))
    return out.select(file, "line", "seg", X.stripped(text).alias("original")).where(X.has_letter(F.col("original")))


def read_csv(spark, path: str) -> DataFrame:
    """Entries exported as CSV with semicolons and a header."""
    schema = "id long, file string, json_path string, context string, original string, translation string, status string"
    return spark.read.csv(path, schema=schema, sep=";", header=True, multiLine=True, escape='"', encoding="UTF-8")


def write_csv(entries: DataFrame, path: str) -> None:
    entries.select("id", "file", "json_path", "context", "original", "translation", "status").write.csv(path, sep=";", header=True, escape='"', quoteAll=True, encoding="UTF-8")
