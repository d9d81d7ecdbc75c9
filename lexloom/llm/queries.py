"""One query for each operator over its whole table, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import language_id, lexical_search, license_scan, line_dedup, lm_scoring, near_dup, packing, quality_rules, sentencepiece_codec, substring_dedup, token_alignment, token_files, topk_search
from lexloom.llm._work import written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    out = quality_rules.host_quality(docs, carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), l AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id
), c AS (
  SELECT l.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM l LEFT JOIN cov ON cov.doc_id = l.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS n FROM c
), r AS (
  SELECT *, base_failed OR n_symbols > n * 0.5 OR word_chars < 2 * n OR word_chars > 20 * n OR 4 * n_dup_lines > n AS fail FROM f
), h AS (
  SELECT source, count(*) AS hn, count(*) FILTER (fail) AS hf FROM r WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT avg(hf / hn) AS mean, coalesce(var_samp(hf / hn), 0) - avg(hf / hn) * (1 - avg(hf / hn)) * avg(1 / hn) AS spread FROM h
), p AS (
  SELECT least(greatest(mean, 1e-6), 1 - 1e-6) AS mean,
         CASE WHEN spread <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, mean * (1 - mean) / spread - 1)) END AS weight FROM m
)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce((hf + mean * weight) / (hn + weight), 0) <= 0.6 AS kept
FROM r CROSS JOIN p LEFT JOIN h ON h.source = r.source
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.license_scan(documents(spark, sf_dir))
    return out.select("doc_id", "license", F.round("dice", 9).alias("dice"), "kind", F.col("at").cast("long").alias("pos"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text")).alias("text_md5"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk_search.exact_topk(vectors, F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = sentencepiece_codec.sp_round_trip(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda ids: F.crc32(F.array_join(ids, " ").cast("binary"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), digest("ids").alias("ids_crc32"), "same", F.size("path").cast("long").alias("n_path"), digest("path").alias("path_crc32"), "path_same")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    manifest = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_documents(manifest).withColumnRenamed("key", "doc_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = lm_scoring.lm_scores(docs, _fold(5) != 1)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def word_tokens(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens: the words of the text, and an end."""
    return docs.select("doc_id", (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).alias("n_tokens"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(word_tokens(documents(spark, sf_dir)))


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = language_id.learned_profiles(docs.where(_fold(4) != 2).select("text", "lang"))
    out = language_id.predict_language(docs.select("doc_id", "text"), profiles, carry=["doc_id"])
    return out.select("doc_id", (F.coalesce(_fold(4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), sets=True)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    made = token_alignment.align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    made = written(made.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", digest), "aligned")
    scores = token_alignment.link_scores(made, written(token_alignment.pair_counts(made), "pairs"))
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return made.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT row, p, md5(b[p:p + 199]) AS h
  FROM (SELECT row, b, unnest(range(1, octet_length(b) - 198)) AS p FROM d WHERE octet_length(b) >= 200)
), r AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
g AS (SELECT row, p, coalesce(p - lag(p) OVER (PARTITION BY row ORDER BY p) > 200, TRUE) AS new FROM r),
i AS (
  SELECT row, min(p) AS a, max(p) + 199 AS z
  FROM (SELECT row, p, count(*) FILTER (new) OVER (PARTITION BY row ORDER BY p) AS k FROM g) GROUP BY row, k
), s AS (
  SELECT d.row, coalesce(lag(z) OVER o, 0) AS a, i.a AS z FROM i JOIN d USING (row) WINDOW o AS (PARTITION BY d.row ORDER BY i.a)
  UNION ALL SELECT d.row, coalesce(max(z), 0), octet_length(any_value(b)) + 1 FROM d LEFT JOIN i USING (row) GROUP BY d.row
), k AS (
  SELECT row, sha256(unhex(array_to_string(list(hex(b[s.a + 1:s.z - 1]) ORDER BY s.a), ''))) AS kept_sha256
  FROM s JOIN d USING (row) GROUP BY row
), n AS (SELECT row, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM i GROUP BY row)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, kept_sha256
FROM d JOIN k USING (row) LEFT JOIN n USING (row)
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return lexical_search.ranked_search(documents(spark, sf_dir).select("doc_id", "text"), items)


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents WHERE text IS NOT NULL)
), d AS (SELECT doc_id, row, t, CAST(len(t) AS BIGINT) AS n FROM t WHERE len(t) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
p AS (SELECT doc_id, row, n, term, count(*) AS tf FROM (SELECT doc_id, row, n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term) CROSS JOIN c
), q AS (
  SELECT item_id, item, term, count(*) AS times FROM (
    SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL
  ) GROUP BY ALL
), s AS (
  SELECT item_id, item, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) CROSS JOIN c GROUP BY item_id, item, doc_id, row
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""


def _op10_sql() -> str:
    rows = ", ".join(f"('{name}', {k}, '" + text.replace("'", "''") + "')" for name, texts in license_scan.TEMPLATES.items() for k, text in enumerate(texts))
    norm = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"""
WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
p AS (
  SELECT doc_id, 'line' AS kind, i - 1 AS pos, l[i] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d))
  UNION ALL
  SELECT doc_id, 'paragraph', i - 1, l[i] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\n[\x20\x09-\x0D]*\n') AS l FROM d)) WHERE contains(l[i], chr(10))
  UNION ALL
  SELECT doc_id, 'text', 0, text FROM d WHERE contains(text, chr(10) || chr(10))
), w AS (SELECT doc_id, kind, pos, string_split({norm.format("s")}, ' ') AS w FROM p),
b AS (SELECT doc_id, kind, pos, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
t AS (SELECT license, k, string_split({norm.format("s")}, ' ') AS w FROM (VALUES {rows}) AS v(license, k, s)),
tb AS (SELECT license, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS tb FROM t),
s AS (
  SELECT doc_id, kind, pos, license, 2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice
  FROM b JOIN tb ON len(b) >= 0.66 * len(tb) AND len(b) <= 1.51 * len(tb)
)
SELECT doc_id, license, round(CAST(dice AS DOUBLE), 9) AS dice, kind, CAST(pos AS BIGINT) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, pos, kind DESC) AS rn FROM s WHERE dice >= 0.8
) WHERE rn = 1
"""


OP3_SQL = r"""
WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL ELSE string_split(text, chr(10)) END AS l FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS s, least(len(l), 3) AS n
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS i FROM d WHERE l IS NOT NULL)
  WHERE trim(array_to_string(l[i:i + 2], '')) <> ''
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY n, s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1
), c AS (
  SELECT doc_id, list(DISTINCT i + o) AS gone FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, text, l, CASE WHEN gone IS NULL THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(gone, i)) END AS k
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id
)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - len(k), 0) AS BIGINT) AS n_removed,
       CAST(length(array_to_string(k, chr(10))) AS BIGINT) AS n_chars_left, md5(array_to_string(k, chr(10))) AS text_md5
FROM f
"""

QUERIES = {"op1_topk_search": op1_topk_search, "op3_line_dedup": op3_line_dedup, "op2_sentencepiece": op2_sentencepiece, "op4_token_files": op4_token_files, "op5_lm_scoring": op5_lm_scoring, "op6_packing": op6_packing, "op7_language_id": op7_language_id, "op8_near_duplicates": op8_near_duplicates, "op9_quality_rules": op9_quality_rules, "op10_license_scan": op10_license_scan, "op11_token_alignment": op11_token_alignment, "op12_substring_dedup": op12_substring_dedup, "op13_lexical_search": op13_lexical_search}
ORACLES = {"op1_topk_search": OP1_SQL, "op3_line_dedup": OP3_SQL, "op9_quality_rules": OP9_SQL, "op10_license_scan": _op10_sql(), "op12_substring_dedup": OP12_SQL, "op13_lexical_search": OP13_SQL}
