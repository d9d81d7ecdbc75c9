"""Quality rules with a host-level verdict (native: DataFrame functions only).

Each document gets counts of words, symbols, repeated lines and repeated three-word windows. Rule failures are added up by
host; each host's failure rate is shrunk with a beta prior fitted to all hosts by moments, and a host whose shrunk rate is
too high takes its documents with it.

Defined results: a null or empty text has no words, so the base rule fails. A null host gets no host verdict, only the base
rule. An empty table gives an empty result. Columns of the input that carry a result's name are replaced. Repeated rows are
judged and counted each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm._work import free_name, without_clash, written

#: Fixed values of the base rule: characters that part words, and symbols.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS. The work of a document stays in its row, so nothing is shuffled."""
    base = without_clash(df, [c for c in COUNTS if c != text])
    t = F.coalesce(F.col(text), F.lit(""))
    w, h, s = (free_name(base, x) for x in ("w__", "h__", "s__"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    triples = lambda a: F.slice(F.arrays_zip(a.alias("a"), F.slice(a, 2, 1 << 30).alias("b"), F.slice(a, 3, 1 << 30).alias("c")), 1, F.greatest(F.size(a) - 2, F.lit(0)))
    out = base.withColumn(w, words(t)).withColumn(h, F.transform(triples(F.col(w)), lambda z: F.xxhash64(z["a"], z["b"], z["c"])))
    # Positions in the order of their hashes; only documents with a repeated window pay for the sort.
    repeats = F.size(F.array_distinct(F.col(h))) < F.size(h)
    out = out.withColumn(s, F.when(repeats, F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), F.col(s))
    near = F.arrays_zip(F.col(s).alias("a"), before.alias("b"), F.slice(s, 2, 1 << 30).alias("c"))
    covered = F.sort_array(F.transform(F.filter(near, lambda z: z["a"].isNotNull() & ((z["a"]["h"] == z["b"]["h"]) | (z["a"]["h"] == z["c"]["h"]))), lambda z: z["a"]["p"]))
    p = free_name(base, "p__")
    out = out.withColumn(p, F.when(repeats, covered))
    steps = F.zip_with(F.col(p), F.slice(p, 2, 1 << 30), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    out = out.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def doc_fails() -> Column:
    """The rules whose failures are added up by host: the base rule, symbols in place of words, words too short or too long, repeated lines."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return F.col("base_failed") | (F.col("n_symbols") > n * 0.5) | (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n) | (4 * F.col("n_dup_lines") > n)


def host_rates(counted: DataFrame, host: str) -> DataFrame:
    """host, n, fails, rate: the share of failing documents, shrunk by a beta prior fitted to the hosts by moments.

    Only sums over hosts reach the driver (one row).
    """
    hosts = counted.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(doc_fails().cast("long")).alias("fails"))
    r = F.col("fails") / F.col("n")
    m = hosts.agg(F.sum("fails").alias("f"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.avg(r).alias("mean"), F.var_samp(r).alias("var"), F.avg(1 / F.col("n")).alias("inv")).first()
    a, b = beta_prior(m["mean"], m["var"], m["inv"], m["k"])
    return hosts.withColumn("rate", (F.col("fails") + F.lit(a)) / (F.col("n") + F.lit(a + b)))


def beta_prior(mean: float | None, var: float | None, inv: float | None, hosts: int) -> tuple[float, float]:
    """a and b of the beta distribution with the hosts' mean rate and their variance less what sampling adds; weight 2 to 1000 documents."""
    if not hosts or mean is None:
        return 1.0, 1.0
    spread = (var or 0.0) - mean * (1 - mean) * (inv or 0.0)
    weight = 1000.0 if spread <= 0 else min(1000.0, max(2.0, mean * (1 - mean) / spread - 1))
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return mean * weight, (1 - mean) * weight


def host_quality(df: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.6, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, if None) with COUNTS, host_rate and kept.

    The counts are written once to the shared folder, as both the sums by host and the join back read them. The hosts'
    table is joined on the host: Spark broadcasts it below its own size limit and else splits the skewed join.
    """
    cols = df.columns if carry is None else carry
    need = [c for c in dict.fromkeys([*cols, host])]
    counted = with_counts(df, text).select(*[f"`{c}`" for c in need if c.lower() not in COUNTS], *COUNTS)
    counted = written(without_clash(counted, ["host_rate", "kept"]), "quality")
    key, rate = free_name(counted, "host__"), host_rates(counted, host)
    rates = rate.select(F.col("host").alias(key), F.col("rate").alias("host_rate"))
    out = counted.join(rates, F.col(f"`{host}`") == F.col(key), "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_rate)
    return out.select(*[f"`{c}`" for c in counted.columns if c in cols or c in COUNTS], "host_rate", kept.alias("kept"))
