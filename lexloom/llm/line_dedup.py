"""Removal of lines that repeat as windows of three consecutive lines.

Every overlapping window of three lines gets a 128-bit hash. A window found again, in any document, is a repeat: its first
occurrence (smallest key, then place) stays, and the lines that later occurrences cover go, as merged spans. A text of one
or two lines is one window of its own. Windows of which every line is blank don't count.

Only hashes and places are shuffled, never texts: sums by hash are combined before the shuffle, so a passage in a third
of all documents is one row for each task; the join back to the places is an ordinary skewed join, which Spark splits.

Defined results: a null text stays null and an empty one empty; a document that loses every line keeps its row with an
empty text. Rows with a null key come after all others, in order of a hash of the text. Rows with the same key are told
apart by their texts; rows equal in key and text are one document: what it loses to others it loses in every row, and they
lose nothing to each other. An empty table gives an empty result. Other columns pass through; those named like a result are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm._work import free_name, without_clash


def line_hashes(text: Column) -> Column:
    """Array of (h, g, full) by line: two hashes, and whether the line isn't blank."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("g"), x).alias("g"), (F.length(F.trim(x)) > 0).alias("full")))


def windows(lines: Column, size: int = 3) -> Column:
    """Array of (at, h, g): place of the first line and two hashes of each window that isn't blank; lines: a column of line_hashes."""
    names = [f"l{k}" for k in range(size)]
    zipped = F.arrays_zip(lines.alias("l0"), *[F.slice(lines, k + 1, 1 << 30).alias(f"l{k}") for k in range(1, size)])
    full = F.slice(zipped, 1, F.greatest(F.size(lines) - (size - 1), F.lit(1)))
    some = lambda z: F.greatest(*[F.coalesce(z[k]["full"], F.lit(False)) for k in names])
    made = F.transform(full, lambda z, i: F.struct(i.alias("at"), F.xxhash64(F.lit(0), *[z[k]["h"] for k in names]).alias("h"), F.xxhash64(F.lit(1), *[z[k]["g"] for k in names]).alias("g"), some(z).alias("full")))
    return F.transform(F.filter(made, lambda z: z["full"]), lambda z: F.struct(z["at"].alias("at"), z["h"].alias("h"), z["g"].alias("g")))


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """df with text without repeats, and n_lines, n_removed (long) and removed, the merged spans [start, end) of lines that went."""
    if size < 2:
        raise ValueError("a window has two lines at least")
    base = without_clash(df, ["n_lines", "n_removed", "removed"])
    doc, lines, cut, left = (free_name(base, x) for x in ("doc__", "lines__", "cut__", "left__"))
    base = base.withColumn(doc, F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.xxhash64(text).alias("t")))
    hashed = base.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), line_hashes(F.col(text)).alias("lines"))
    at = hashed.select("doc", F.inline(windows(F.col("lines"), size)))
    first = at.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at")).alias("first")).where("n > 1")
    later = at.join(first, ["h", "g"]).where(F.struct("doc", "at") != F.col("first"))
    # Starts of repeated windows by document: bounded by the document's own lines.
    gone = later.groupBy("doc").agg(F.collect_set("at").alias("starts")).withColumnRenamed("doc", doc)
    j = base.join(gone, doc, "left").withColumn(lines, F.split(F.col(text), "\n"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1)))))
    j = j.withColumn(cut, F.when(F.col("starts").isNotNull(), F.sort_array(F.filter(covered, lambda i: i < F.size(F.col(lines))))))
    j = j.withColumn(left, F.when(F.col(cut).isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))))
    kept = F.array_join(F.transform(F.col(left), lambda i: F.get(F.col(lines), i)), "\n")
    after = F.transform(F.col(cut), lambda i: i + 1)
    spans = F.zip_with(F.array_except(F.col(cut), after), F.array_except(after, F.col(cut)), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return j.select(
        *[F.when(F.col(left).isNotNull(), kept).otherwise(F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`") for c in base.columns if c != doc],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
    )
