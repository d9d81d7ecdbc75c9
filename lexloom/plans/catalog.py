"""Registered queries of the text-localisation operators, and the SQL that must give the same rows.

`documents` carries the entries: one for each line, its file the source, its status and translation from `labels`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import codes as C
from lexloom.functions import text as X
from lexloom.operators import entries as E
from lexloom.operators import snapshots as S
from lexloom.sources import markup as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: White space that stripping removes, in the other engine's syntax.
_SP = r"[\s\x{3000}\x{a0}]"


def _blank(x: str) -> str:
    return f"(regexp_replace(coalesce({x}, ''), '^{_SP}+|{_SP}+$', '', 'g') = '')"



_ENTRIES = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS file, lang AS context, i - 1 AS line, l[i] AS original
  FROM (SELECT doc_id, source, lang, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
), e AS (
  SELECT lines.doc_id * 16777216 + line AS id, file, 'doc[' || lines.doc_id || '].line[' || line || ']' AS json_path, context, original,
         CASE WHEN labels.quality IS NULL THEN '' ELSE lower(original) END AS translation,
         CASE WHEN toxic = 1 THEN 'skip' WHEN quality = 1 THEN 'translated' WHEN quality = 0 THEN 'manual' ELSE 'new' END AS status
  FROM lines LEFT JOIN labels ON labels.doc_id = lines.doc_id WHERE NOT {_blank("original")}
)
"""
_LANG = """CASE WHEN regexp_matches({0}, '[\u3040-\u30ff\u31f0-\u31ff]') THEN 'ja' WHEN regexp_matches({0}, '[\u4e00-\u9fff\u3400-\u4dbf]') THEN 'zh' WHEN regexp_matches({0}, '[\uac00-\ud7a3]') THEN 'ko' WHEN regexp_matches({0}, '[\u0400-\u04ff]') THEN 'ru' WHEN regexp_matches({0}, '[A-Za-z]') THEN 'en' END"""
_BARE = r"regexp_replace({0}, '\\[A-Za-z]?\[[^\]]*\]|\\[{{}}<>|.!^_]?|\\[A-Za-z]+|%[0-9]+', '', 'g')"
_COLS = "id, file, json_path, context, original, translation, status"


def _lang(x: str) -> str:
    return _LANG.format(_BARE.format(x))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("file"), F.col("lang").alias("context"), F.posexplode(F.split("text", "\n")).alias("line", "original"))
    out = docs.where(~X.is_blank(F.col("original"))).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return out.select(
        (F.col("doc_id") * (1 << 24) + F.col("line")).alias("id"),
        "file",
        F.concat(F.lit("doc["), "doc_id", F.lit("].line["), "line", F.lit("]")).alias("json_path"),
        "context",
        "original",
        F.when(F.col("quality").isNull(), "").otherwise(F.lower("original")).alias("translation"),
        F.when(F.col("toxic") == 1, "skip").when(F.col("quality") == 1, "translated").when(F.col("quality") == 0, "manual").otherwise("new").alias("status"),
    )


_LATIN, _CYRILLIC_LETTERS = "abcdefghijklmnoprstuvyz", "абцдефгхийклмнопрстуваз"
#: Every third file is in Cyrillic letters; each document is a file of its own; every fifth line is known from before.
_SPOKEN = f"{_ENTRIES}, s AS (SELECT * REPLACE (CASE WHEN right(file, 1) IN ('1', '4', '7') THEN translate(lower(original), '{_LATIN}', '{_CYRILLIC_LETTERS}') ELSE original END AS original) FROM e)"
_BY_DOCUMENT = f"{_ENTRIES}, f AS (SELECT * REPLACE (file || '/' || (id >> 24) AS file) FROM e)"
_KNOWN_LINES = "SELECT original AS source, 'm' || max(id) AS target FROM e WHERE id % 5 = 0 GROUP BY original"


def spoken(e: DataFrame) -> DataFrame:
    own = F.right("file", F.lit(1)).isin("1", "4", "7")
    return e.withColumn("original", F.when(own, F.translate(F.lower("original"), _LATIN, _CYRILLIC_LETTERS)).otherwise(F.col("original")))


def by_document(e: DataFrame) -> DataFrame:
    return e.withColumn("file", F.concat("file", F.lit("/"), F.shiftright("id", 24)))


def known_lines(e: DataFrame) -> DataFrame:
    """A translation memory of lines met before."""
    rows = e.where("id % 5 = 0").groupBy("original").agg(F.max("id").alias("ord"))
    return rows.select(F.col("original").alias("source"), F.lit("en").alias("src_lang"), F.lit("ru").alias("tgt_lang"), F.concat(F.lit("m"), "ord").alias("target"), "ord")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["file_stats"](spark, sf_dir)


@query("scan_entries", f"{_ENTRIES} SELECT {_COLS} FROM e")
def scan_entries(spark, d):
    return entries(spark, d)


@query("detect_lang", f"{_ENTRIES}, v AS (SELECT id, original AS t FROM e UNION ALL SELECT -1, '\\V[1]\u3042\u4e2d' UNION ALL SELECT -2, '\\C\u0416x %1' UNION ALL SELECT -3, '\ud55c' UNION ALL SELECT -4, '%1 12') SELECT id, {_lang('t')} AS lang FROM v")
def detect_lang(spark, d):
    more = spark.createDataFrame([(-1, "\\V[1]\u3042\u4e2d"), (-2, "\\C\u0416x %1"), (-3, "\ud55c"), (-4, "%1 12")], "id long, t string")
    rows = entries(spark, d).select("id", F.col("original").alias("t")).union(more)
    return rows.select("id", X.detect_lang(F.col("t")).alias("lang"))


@query("token_estimate", f"{_ENTRIES} SELECT id, CAST(greatest(1, CASE WHEN regexp_matches(original, '[\u3000-\u9fff\uf900-\ufaff\uac00-\ud7af]') THEN length(original) ELSE length(original) // 4 END) AS INTEGER) AS tokens FROM e")
def token_estimate(spark, d):
    return entries(spark, d).select("id", X.estimate_tokens(F.col("original")).alias("tokens"))


@query("workset_filter", f"{_ENTRIES} SELECT {_COLS} FROM e WHERE {_blank('translation')} AND status <> 'skip'")
def workset_filter(spark, d):
    return E.work_set(entries(spark, d))


_VIEWS = {"new": f"{_blank('translation')} AND status <> 'skip'", "all": "true", "untranslated": _blank("translation"), "draft": f"NOT {_blank('translation')} AND status NOT IN ('skip', 'translated', 'corrected')", "done": f"NOT {_blank('translation')} AND status IN ('translated', 'corrected')", "skip": "status = 'skip'"}
for _mode in E.VIEWS:
    query(f"view_filter_{_mode}", f"{_ENTRIES} SELECT id, status FROM e WHERE {_VIEWS[_mode]}")(lambda spark, d, mode=_mode: E.view(entries(spark, d), mode).select("id", "status"))


@query("entry_search", f"{_ENTRIES} SELECT id FROM e WHERE contains(lower(original), 'tion') OR contains(lower(translation), 'tion')")
def entry_search(spark, d):
    return E.view(entries(spark, d), "done", "TION").select("id")


@query("file_search_semi", f"{_BY_DOCUMENT} SELECT DISTINCT file FROM f WHERE contains(lower(file), 'src1') OR contains(lower(original), 'license') OR contains(lower(translation), 'license')")
def file_search_semi(spark, d):
    e = by_document(entries(spark, d))
    return E.file_search(e, "src1").union(E.file_search(e, "license")).distinct()


@query("state_of", f"{_ENTRIES} SELECT id, CASE WHEN status = 'skip' THEN 'skip' WHEN status IN ('translated', 'corrected') THEN 'done' WHEN status = 'manual' THEN 'draft' ELSE 'empty' END AS state FROM e")
def state_of(spark, d):
    return entries(spark, d).select("id", X.state_of(F.col("status")).alias("state"))


_TOKEN_SQL = r"SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'see ' || url WHEN 2 THEN 'img/' || page_id || '.png' WHEN 3 THEN '#ff00' || page_id ELSE replace(url, 'http', 'ftp') END AS t FROM pages WHERE url <> ''"


@query("code_token", rf"SELECT page_id, NOT regexp_matches(t, '\s') AND (regexp_matches(t, '^https?://') OR regexp_matches(t, '^#[0-9a-fA-F]{{3,8}}$') OR (regexp_matches(t, '[\\/]') AND regexp_matches(t, '\.[A-Za-z0-9]{{1,5}}$'))) AS code FROM ({_TOKEN_SQL})")
def code_token(spark, d):
    """Addresses, the same within words, paths, colours and what looks like none of them."""
    k = F.col("page_id") % 5
    t = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("see "), "url")).when(k == 2, F.concat(F.lit("img/"), "page_id", F.lit(".png"))).when(k == 3, F.concat(F.lit("#ff00"), "page_id")).otherwise(F.replace("url", F.lit("http"), F.lit("ftp")))
    return table(spark, d, "pages").where("url <> ''").select("page_id", X.is_code_token(t).alias("code"))


@query("script_fit", f"{_ENTRIES} SELECT id, CASE WHEN length(regexp_replace(original, '[^\\p{{L}}]', '', 'g')) = 0 THEN 1.0 ELSE CAST(length(regexp_replace(original, '[^A-Za-z]', '', 'g')) AS DOUBLE) / length(regexp_replace(original, '[^\\p{{L}}]', '', 'g')) END AS fit FROM e")
def script_fit(spark, d):
    return entries(spark, d).select("id", X.script_fit(F.col("original"), "en").alias("fit"))


@query(
    "repeated_stems",
    f"{_ENTRIES}, w AS (SELECT id, list_transform(regexp_extract_all(original, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)[1:5]) AS s FROM e), c AS (SELECT id, sum(n) AS n, coalesce(sum(n) FILTER (n > 1), 0) AS r FROM (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(s) AS x FROM w) GROUP BY id, x) GROUP BY id) SELECT w.id, CASE WHEN coalesce(n, 0) < 4 THEN 0.0 ELSE CAST(r AS DOUBLE) / n END AS ratio FROM w LEFT JOIN c ON c.id = w.id",
)
def repeated_stems(spark, d):
    return entries(spark, d).select("id", X.repeated_stems(F.col("original")).alias("ratio"))


@query("context_short", "SELECT page_id, CASE WHEN len(p) > 2 THEN p[-2] || '/' || p[-1] ELSE url END AS short FROM (SELECT page_id, url, list_filter(string_split(replace(url, '\\', '/'), '/'), lambda x: x <> '') AS p FROM pages)")
def context_short(spark, d):
    return table(spark, d, "pages").select("page_id", X.context_short(F.col("url")).alias("short"))


@query("fix_leading_case", f"{_ENTRIES} SELECT id, CASE WHEN regexp_matches(original, '^\\p{{L}}') AND lower(original[1]) = lower(translation[1]) AND original[1] <> translation[1] THEN original[1] || translation[2:] ELSE translation END AS fixed FROM e")
def fix_leading_case(spark, d):
    return entries(spark, d).select("id", X.fix_leading_case(F.col("original"), F.col("translation")).alias("fixed"))


@query("mask_roundtrip")
def mask_roundtrip(spark, d):
    """Codes set into each line, masked and put back: `same` must be true everywhere."""
    rows = entries(spark, d).select("id", F.concat(F.lit("\\C[8]"), "original", F.lit(" %1 <b>\\V[2]</b>")).alias("t"))
    m = rows.withColumn("m", C.mask_codes(F.col("t")))
    return m.select("id", F.size("m.codes").alias("n"), X.tokens_valid(F.col("m.masked"), F.size("m.codes")).alias("valid"), (C.unmask_codes(F.col("m.masked"), F.col("m.codes")) == F.col("t")).alias("same"))


@query("project_stats", f"{_ENTRIES} SELECT count(*) FILTER (NOT {_blank('translation')} AND status <> 'skip') AS done, count(*) FILTER (NOT {_blank('translation')} AND status = 'skip') AS draft, count(*) FILTER ({_blank('translation')}) AS empty, count(*) AS total FROM e")
def project_stats(spark, d):
    return E.project_stats(entries(spark, d))


@query("file_stats", f"{_ENTRIES}, s AS (SELECT file, count(*) AS total, count(*) FILTER (NOT {_blank('translation')} AND status <> 'skip') AS done, grouping(file) AS is_all FROM e GROUP BY ROLLUP (file)) SELECT file, total, done, is_all, CAST(round_even(CAST(done AS DOUBLE) / total * 100, 0) AS INTEGER) AS percent FROM s")
def file_stats(spark, d):
    return E.file_stats(entries(spark, d))


@query("completed_files", f"{_BY_DOCUMENT} SELECT count(*) FILTER (a) AS completed, count(*) AS files FROM (SELECT file, bool_and(NOT {_blank('translation')} AND status <> 'skip') AS a FROM f GROUP BY file)")
def completed_files(spark, d):
    return E.completed_files(by_document(entries(spark, d)))


@query("file_is_target_lang", f"{_SPOKEN} SELECT file, coalesce(bool_and(lang = 'en'), false) AS is_target FROM (SELECT file, {_lang('original')} AS lang, row_number() OVER (PARTITION BY file ORDER BY id) AS r FROM s) WHERE r <= 40 GROUP BY file")
def file_is_target_lang(spark, d):
    return E.target_language_files(spoken(entries(spark, d)), "en")


@query("overlay_dict", f"{_ENTRIES} SELECT original, max_by(translation, id) AS translation FROM e WHERE NOT {_blank('translation')} AND status <> 'skip' GROUP BY original")
def overlay_dict(spark, d):
    return E.overlay(entries(spark, d))


@query("dedup_first_wins", f"{_ENTRIES} SELECT min_by(file, id) AS file, original, min(id) AS id FROM e GROUP BY original")
def dedup_first_wins(spark, d):
    return E.first_of(entries(spark, d).select("id", "file", "original"), ["original"], "id").select("file", "original", "id")


@query("dedup_holders", f"{_ENTRIES} SELECT lang, original, min(id) AS first_id, count(*) AS n FROM (SELECT *, {_lang('original')} AS lang FROM e WHERE {_blank('translation')} AND status <> 'skip') WHERE lang IS NOT NULL AND lang <> 'ru' GROUP BY lang, original")
def dedup_holders(spark, d):
    return E.holders(entries(spark, d), "ru")


@query(
    "merge_extracted",
    f"{_ENTRIES}, old AS (SELECT * FROM e WHERE NOT {_blank('translation')}), k AS (SELECT file, json_path, max_by(translation, id) AS t, max_by(status, id) AS s FROM old GROUP BY ALL), x AS (SELECT original, max_by(translation, id) AS t, max_by(status, id) AS s FROM old GROUP BY ALL) "
    "SELECT e.id, e.file, e.json_path, e.context, e.original, coalesce(k.t, x.t, '') AS translation, coalesce(k.s, x.s, 'new') AS status, k.t IS NOT NULL OR x.t IS NOT NULL AS restored FROM e LEFT JOIN k ON k.file = e.file AND k.json_path = e.json_path LEFT JOIN x ON x.original = e.original",
)
def merge_extracted(spark, d):
    old = entries(spark, d)
    return E.merge_previous(old.withColumn("translation", F.lit("")).withColumn("status", F.lit("new")), old)


@query("update_by_id", f"{_ENTRIES} SELECT id, file, json_path, context, original, 'second' AS translation, 'manual' AS status FROM e WHERE NOT {_blank('translation')} UNION ALL SELECT {_COLS} FROM e WHERE {_blank('translation')}")
def update_by_id(spark, d):
    """Two changes of each translated entry, the later one counts, and a blank one of every entry, which doesn't."""
    e = entries(spark, d)
    rows = e.where(~X.is_blank(F.col("translation"))).select("id")
    changes = rows.select("id", F.lit(1).alias("ord"), F.lit("first").alias("translation")).union(rows.select("id", F.lit(2), F.lit("second"))).union(e.select("id", F.lit(3), F.lit("  ")))
    return E.update_by_id(e, changes)


_TM = "SELECT text AS source, 'en' AS src_lang, 'ru' AS tgt_lang, 'b' || max(item_id) AS target FROM benchmark WHERE text IS NOT NULL GROUP BY text"


def memory(spark, d):
    b = table(spark, d, "benchmark").where("text IS NOT NULL")
    return E.tm_upsert(b.where("1 = 0").select(F.col("text").alias("source"), F.lit("en").alias("src_lang"), F.lit("ru").alias("tgt_lang"), F.lit("").alias("target")), b.select(F.col("text").alias("source"), F.lit("en").alias("src_lang"), F.lit("ru").alias("tgt_lang"), F.concat(F.lit("b"), "item_id").alias("target"), F.col("item_id").alias("ord")))


@query("tm_upsert", "SELECT text AS source, 'en' AS src_lang, 'ru' AS tgt_lang, 'b' || max_by(item_id, item_id) AS target FROM benchmark WHERE text IS NOT NULL GROUP BY text")
def tm_upsert(spark, d):
    return memory(spark, d)


@query("tm_lookup", f"{_ENTRIES}, tm AS ({_KNOWN_LINES}) SELECT id, original, target AS tm_target FROM e LEFT JOIN tm ON tm.source = original")
def tm_lookup(spark, d):
    e = entries(spark, d)
    return E.tm_lookup(e.select("id", "original"), known_lines(e), "en", "ru")


@query("glossary_match", "SELECT DISTINCT p_partkey, term FROM part, (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part) WHERE contains(p_name, term) AND term <> ''")
def glossary_match(spark, d):
    part = table(spark, d, "part")
    return E.glossary_matches(part, part.select(F.explode(F.split("p_name", " ")).alias("term")), "p_partkey", "p_name").distinct()


@query("glossary_match_lines", f"{_ENTRIES} SELECT DISTINCT id, term FROM e, (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part) WHERE contains(original, term) AND term <> ''")
def glossary_match_lines(spark, d):
    return E.glossary_matches(entries(spark, d), table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term")), "id", "original").distinct()


@query("context_window", "SELECT conv_id, turn, coalesce(list(text) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS before, coalesce(list(text) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS after FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context_window(spark, d):
    return E.context_window(table(spark, d, "conversations").where("text IS NOT NULL"), ["conv_id"], "turn", "text").select("conv_id", "turn", "before", "after")


@query("greedy_batches")
def greedy_batches(spark, d):
    """Batches of each document's lines; the sum of a batch's tokens is over the limit for a single line only."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("l"))
    sizes = F.transform("l", lambda x: X.estimate_tokens(x))
    rows = docs.select("doc_id", F.inline(F.arrays_zip(sizes.alias("tokens"), E.greedy_batches(sizes, 150, 10).alias("batch"))))
    return rows.groupBy("doc_id", "batch").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


@query("term_sample", f"{_ENTRIES}, t AS (SELECT regexp_replace(original, '^{_SP}+|{_SP}+$', '', 'g') AS term, min(id) AS id FROM e GROUP BY 1 HAVING length(term) BETWEEN 1 AND 200), r AS (SELECT *, row_number() OVER (ORDER BY id) AS rank, coalesce(sum(length(term)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT id, term FROM r WHERE before < 12000 AND rank <= 80")
def term_sample(spark, d):
    return E.term_sample(entries(spark, d))


@query("html_segments", r"WITH p AS (SELECT page_id, string_split_regex(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '<>', 'g'), '<[^>]*>') AS s FROM pages), x AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS seg, regexp_replace(s[i], '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g') AS original FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM p)) SELECT * FROM x WHERE regexp_matches(original, '\p{L}')")
def html_segments(spark, d):
    return M.html_segments(table(spark, d, "pages"))


_SNAP = "SELECT user_id, event_type, ts, event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events"


@query("snapshot_diff", f"SELECT user_id, event_type, event_id, previous, value FROM ({_SNAP}) WHERE previous IS NOT NULL AND previous <> value")
def snapshot_diff(spark, d):
    return S.changes(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value").select("user_id", "event_type", "event_id", "previous", "value")


_HALF = "(SELECT user_id, event_type, max_by(CAST(floor(value / 20) AS BIGINT), {{'t': ts, 'e': event_id}}) AS value FROM events WHERE event_id % 2 = {0} GROUP BY ALL)"
for _mode, _op in {"changed": "<>", "unchanged": "=", "increased": ">", "decreased": "<"}.items():
    query(f"value_scan_{_mode}", f"SELECT c.user_id, c.event_type, p.value AS was, c.value FROM {_HALF.format(0)} p JOIN {_HALF.format(1)} c USING (user_id, event_type) WHERE c.value {_op} p.value")(
        lambda spark, d, mode=_mode: S.value_scan(*[S.latest(table(spark, d, "events").where(f"event_id % 2 = {k}").withColumn("value", F.floor(F.col("value") / 20)), ["user_id", "event_type"], ["ts", "event_id"], "value") for k in (0, 1)], ["user_id", "event_type"], "value", mode).select("user_id", "event_type", "was", "value")
    )


@query("known_indices", "SELECT DISTINCT idx FROM (SELECT user_id AS idx FROM events UNION ALL SELECT c_custkey FROM customer) WHERE idx > 0")
def known_indices(spark, d):
    return S.known_indices(table(spark, d, "events").select(F.col("user_id").alias("idx")), table(spark, d, "customer").select(F.col("c_custkey").alias("idx")))


@query("top_recent", "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 8")
def top_recent(spark, d):
    """A report of the eight latest."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "user_id").limit(8)
