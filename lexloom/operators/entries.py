"""Operators on text entries: id, file, json_path, context, original, translation, status."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as X

ENTRY = ["id", "file", "json_path", "context", "original", "translation", "status"]
#: Bytes of terms that may go to every task.
TERM_BYTES = 4 << 20
#: View modes, in the order of their numbers.
VIEWS = ("new", "all", "untranslated", "draft", "done", "skip")


def is_done() -> Column:
    return ~X.is_blank(F.col("translation")) & (F.col("status") != "skip")


def work_set(entries: DataFrame, overwrite: bool = False) -> DataFrame:
    return entries if overwrite else entries.where(X.is_blank(F.col("translation")) & (F.col("status") != "skip"))


def applicable(entries: DataFrame) -> DataFrame:
    return entries.where(is_done())


def matches(query: str) -> Column:
    q = query.lower()
    return F.contains(F.lower(F.col("original")), F.lit(q)) | F.contains(F.lower(F.col("translation")), F.lit(q))


def view(entries: DataFrame, mode: str, search: str = "") -> DataFrame:
    """A non-empty search replaces the mode's filter."""
    if search:
        return entries.where(F.coalesce(matches(search), F.lit(False)))
    blank, skip, good = X.is_blank(F.col("translation")), F.col("status") == "skip", F.col("status").isin("translated", "corrected")
    rule = {"new": blank & ~skip, "all": F.lit(True), "untranslated": blank, "draft": ~blank & ~skip & ~good, "done": ~blank & good, "skip": skip}[mode]
    return entries.where(rule)


def file_search(entries: DataFrame, query: str) -> DataFrame:
    """Files whose name or any of whose rows matches."""
    hit = F.contains(F.lower(F.col("file")), F.lit(query.lower())) | F.coalesce(matches(query), F.lit(False))
    return entries.groupBy("file").agg(F.bool_or(hit).alias("hit")).where("hit").select("file")


def project_stats(entries: DataFrame) -> DataFrame:
    blank, skip = X.is_blank(F.col("translation")), F.col("status") == "skip"
    return entries.agg(F.count_if(~blank & ~skip).alias("done"), F.count_if(~blank & skip).alias("draft"), F.count_if(blank).alias("empty"), F.count(F.lit(1)).alias("total"))


def file_stats(entries: DataFrame) -> DataFrame:
    """file (null: all files), total, done, percent (halves to even)."""
    out = entries.rollup("file").agg(F.count(F.lit(1)).alias("total"), F.count_if(is_done()).alias("done"), F.grouping("file").alias("is_all"))
    return out.withColumn("percent", F.bround(F.col("done") / F.col("total") * 100, 0).cast("int"))


def completed_files(entries: DataFrame) -> DataFrame:
    return entries.groupBy("file").agg(F.every(is_done()).alias("all")).agg(F.count_if("all").alias("completed"), F.count(F.lit(1)).alias("files"))


def target_language_files(entries: DataFrame, target: str, sample: int = 40) -> DataFrame:
    """file, is_target: of the first rows with text, all whose language is known are in the target's."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy("id"))
    found = entries.where(~X.is_blank(F.col("original"))).withColumn("rank", rank).where(F.col("rank") <= sample)
    return found.withColumn("lang", X.detect_lang(F.col("original"))).groupBy("file").agg(F.coalesce(F.bool_and(F.col("lang") == target), F.lit(False)).alias("is_target"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. Each task reduces its rows before the shuffle, so a hot key costs one row for each task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*").select(*rows.columns)


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*").select(*rows.columns)


def overlay(entries: DataFrame) -> DataFrame:
    """original, translation of the applicable rows; the last of an original wins."""
    return last_of(applicable(entries).select("id", "original", "translation"), ["original"], "id").select("original", "translation")


def merge_previous(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """fresh with the translation and status of old rows: by file and path, else by original; restored says whether."""
    useful = old.where(~X.is_blank(F.col("translation"))).select("id", "file", "json_path", "original", "translation", "status")
    last = F.max_by(F.struct("translation", "status"), "id")
    by_key = useful.groupBy("file", "json_path").agg(last.alias("by_key"))
    by_text = useful.groupBy("original").agg(last.alias("by_text"))
    out = fresh.join(by_key, ["file", "json_path"], "left").join(by_text, "original", "left")
    hit = F.coalesce("by_key", "by_text")
    return out.select(
        *[c for c in ENTRY if c not in ("translation", "status")],
        F.coalesce(hit["translation"], "translation").alias("translation"),
        F.coalesce(hit["status"], "status").alias("status"),
        hit.isNotNull().alias("restored"),
    )


def update_by_id(entries: DataFrame, changes: DataFrame, status: str = "manual") -> DataFrame:
    """Non-blank translations of changes (id, ord, translation) replace; the last of an id wins."""
    new = last_of(changes.where(~X.is_blank(F.col("translation"))).select("id", "ord", "translation"), ["id"], "ord").select("id", F.col("translation").alias("new"))
    out = entries.join(new, "id", "left")
    return out.select(*[c for c in ENTRY if c not in ("translation", "status")], F.coalesce("new", "translation").alias("translation"), F.when(F.col("new").isNotNull(), status).otherwise(F.col("status")).alias("status"))


def holders(entries: DataFrame, target: str, declared: str = "auto") -> DataFrame:
    """lang, original, first_id, n: each text to translate once, in order of first_id."""
    rows = work_set(entries).withColumn("lang", X.resolve_source(F.col("original"), declared, target)).where("lang IS NOT NULL")
    return rows.groupBy("lang", "original").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def memory_texts(memory: DataFrame, target: str) -> DataFrame:
    """original, lang, text of a translation memory; of a key that is there several times the last (by ord, if there is one, else by text) counts."""
    own = memory.where((F.col("tgt_lang") == target) & (F.col("target") != ""))
    order = F.struct("ord", "target") if "ord" in memory.columns else F.col("target")
    return own.groupBy(F.col("source").alias("original"), F.col("src_lang").alias("lang")).agg(F.max_by("target", order).alias("text"))


def tm_lookup(entries: DataFrame, memory: DataFrame, source: str, target: str) -> DataFrame:
    """entries with tm_target, the translation memory's text for them (null: none)."""
    own = memory_texts(memory, target).where(F.col("lang") == source).select("original", F.col("text").alias("tm_target"))
    return entries.join(own, "original", "left")


def tm_upsert(memory: DataFrame, new: DataFrame) -> DataFrame:
    """memory with new's rows (ord tells which of equal keys is last) in place of those of the same key."""
    cols = ["source", "src_lang", "tgt_lang", "target"]
    both = memory.select(*cols, F.lit(-1).cast("long").alias("ord")).unionByName(new.select(*cols, F.col("ord").cast("long").alias("ord")))
    return last_of(both, cols[:3], "ord").select(*cols)


def context_window(lines: DataFrame, group: list[str], order: str, text: str, width: int = 3) -> DataFrame:
    """lines with before and after, the texts next to each within its group."""
    w = Window.partitionBy(*group).orderBy(order)
    return lines.withColumn("before", F.collect_list(text).over(w.rowsBetween(-width, -1))).withColumn("after", F.collect_list(text).over(w.rowsBetween(1, width)))


def greedy_batches(sizes: Column, most: int = 1500, lines: int = 100) -> Column:
    """Of an array of sizes, the batch number of each: a batch closes when the next doesn't fit, or at `lines`. A fold in the row, no shuffle."""
    zero = F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("t"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        x = x.cast("long")
        cut = (s["n"] > 0) & ((s["t"] + x > most) | (s["t"] >= most) | (s["n"] >= lines))
        b = s["b"] + cut.cast("int")
        return F.struct(b.alias("b"), F.when(cut, x).otherwise(s["t"] + x).alias("t"), F.when(cut, 1).otherwise(s["n"] + 1).alias("n"), F.concat(s["out"], F.array(b)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def term_sample(entries: DataFrame, chars: int = 12_000, most: int = 80, longest: int = 200, least: int = 5) -> DataFrame:
    """The first distinct texts until their lengths reach chars, most of them at most; none if under least."""
    t = entries.select("id", X.stripped(F.col("original")).alias("term")).where((F.col("term") != "") & (F.length("term") <= longest))
    # The shortest text has one character, so the first `chars` texts hold the sample.
    first = t.groupBy("term").agg(F.min("id").alias("id")).orderBy("id").limit(max(most, least))
    before = F.coalesce(F.sum(F.length("term")).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = first.withColumn("rank", F.row_number().over(Window.orderBy("id"))).withColumn("before", before).withColumn("n", F.count(F.lit(1)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.where((F.col("n") >= least) & (F.col("before") < chars) & (F.col("rank") <= most)).select("id", "term")


def glossary_matches(rows: DataFrame, terms: DataFrame, key: str, text: str, gram: int = 4) -> DataFrame:
    """key, term for every term within the text, once for each row; no cross join.

    Terms of up to TERM_BYTES together go to all tasks, and one automaton of them reads each text once. Beyond that an equi-join on
    the terms' first characters finds candidates, by key alone, and the text is joined back to check what it brings; keys are unique then.
    """
    keyed = terms.select("term").where(F.col("term") != "").distinct()
    if (keyed.agg(F.sum(F.octet_length("term"))).first()[0] or 0) <= TERM_BYTES:
        return _automaton_matches(rows.select(key, text), [r["term"] for r in keyed.collect()])
    keyed = keyed.withColumn("g", F.substring("term", 1, gram))
    lengths = sorted(r["n"] for r in keyed.select(F.length("g").alias("n")).distinct().collect())
    t = F.col(text)
    # One pass over the text; a substring would cost as much as its place each time.
    cut = lambda n: F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    none = F.array().cast("array<string>")
    begins = F.array_distinct(F.concat(none, *[cut(n) for n in lengths]))
    # Only the key and a beginning are exploded, never the text.
    near = rows.select(key, begins.alias("gs")).select(key, F.explode("gs").alias("g")).join(keyed, "g").select(key, "term")
    return near.join(rows.select(key, text), key).where(t.contains(F.col("term"))).select(key, "term")


@lru_cache(2)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for term in terms:
        made.add_word(term, term)
    made.make_automaton()
    return made


def _automaton_matches(rows: DataFrame, terms: list[str]) -> DataFrame:
    key, shared = rows.schema.fields[0], rows.sparkSession.sparkContext.broadcast(tuple(sorted(terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(shared.value)
        for b in batches:
            if len(made):
                found = [list(dict.fromkeys(term for _, term in made.iter(t))) if t else [] for t in b.column(1).to_pylist()]
                at = np.repeat(np.arange(len(found)), list(map(len, found)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([x for f in found for x in f], pa.string())], names=[key.name, "term"])

    return rows.mapInArrow(run, T.StructType([key, T.StructField("term", T.StringType())]))


def dashboard(entries: DataFrame) -> DataFrame:
    """done (skipped rows with a translation count, too), remaining, total."""
    done = F.count_if(~X.is_blank(F.col("translation")))
    return entries.agg(done.alias("done"), (F.count(F.lit(1)) - done).alias("remaining"), F.count(F.lit(1)).alias("total"))


def worker_counters(entries: DataFrame) -> DataFrame:
    """translated, and skipped: rows set to skip without a translation."""
    return entries.agg(F.count_if(F.col("status") == "translated").alias("translated"), F.count_if((F.col("status") == "skip") & X.is_blank(F.col("translation"))).alias("skipped"))


def file_order(entries: DataFrame, target: str) -> DataFrame:
    """file, place (from 1): by name, files in the target language last."""
    files = entries.select("file").distinct().join(target_language_files(entries, target), "file", "left")
    # One row for each file.
    place = F.row_number().over(Window.orderBy(F.coalesce("is_target", F.lit(False)), "file"))
    return files.select("file", place.alias("place"))


def table_page(entries: DataFrame, most: int = 10_000) -> DataFrame:
    """The rows that a table shows."""
    return entries.orderBy("id").limit(most)


def sizes(entries: DataFrame) -> DataFrame:
    """file, rows, chars of the originals and of the translations."""
    return entries.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("original")).alias("chars"), F.sum(F.length("translation")).alias("translated_chars"))


def not_among(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """rows whose value isn't among known's: literals that aren't parameter keys, texts that a file lacks."""
    return rows.join(known.select(column).distinct(), column, "left_anti").select(*rows.columns)


def holder_rows(entries: DataFrame, target: str, declared: str = "auto") -> DataFrame:
    """id, first_id: each row to translate and the one that stands for its text."""
    rows = work_set(entries).withColumn("lang", X.resolve_source(F.col("original"), declared, target)).where("lang IS NOT NULL")
    first = rows.groupBy("lang", "original").agg(F.min("id").alias("first_id"))
    return rows.join(first, ["lang", "original"]).select("id", "first_id")


def string_pairs(entries: DataFrame) -> DataFrame:
    """file, id, tag, old, new: what the string files of a script game hold. Of equal texts of the applicable rows the first has its place, in whichever file."""
    first = first_of(applicable(entries).select("file", "id", "original", "translation"), ["original"], "id")
    return first.select("file", "id", X.short_hash(F.col("original")).alias("tag"), X.escape_literal(F.col("original")).alias("old"), X.escape_literal(F.col("translation")).alias("new"))


def string_counts(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """strings, new_strings: how many pairs, and how many of those the last run's (old) lack."""
    known = existing.select("old").distinct().withColumn("known", F.lit(True))
    return pairs.join(known, "old", "left").agg(F.count(F.lit(1)).alias("strings"), F.count_if(F.col("known").isNull()).alias("new_strings"))


def term_groups(terms: DataFrame) -> DataFrame:
    """grp, place (from 1): the groups of a glossary (ord, grp) as they first appear; blank ones are left out."""
    groups = terms.where(~X.is_blank(F.col("grp"))).groupBy("grp").agg(F.min("ord").alias("ord"))
    # One row for each group.
    return groups.select("grp", F.row_number().over(Window.orderBy("ord", "grp")).alias("place"))
