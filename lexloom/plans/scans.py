"""Registered queries of scanned stories and scripts, batches over whole groups and merged saves, with their SQL.

`documents` gives the text: each is a story, and a script, whose lines stand in turn as plain text, in a shown and in a hidden place.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import answers as AN
from lexloom.functions import text as X
from lexloom.operators import batches as B
from lexloom.operators import engines as G
from lexloom.operators import offline as O
from lexloom.operators import saves
from lexloom.operators import write_back as W
from lexloom.plans.catalog import _ENTRIES, _SP, entries, query, table
from lexloom.plans.translation import _JS
from lexloom.sources import game_json
from lexloom.sources import markup as M
from lexloom.sources import plugins as J
from lexloom.sources import save_files as L
from lexloom.sources import scripts as R
from lexloom.sources import stories as S

_strip = lambda x: f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"
#: Characters that are code in a story or a script, taken out so that the lines are text.
_STORY_CODE, _SCRIPT_CODE = r"""[<>$&"'|\\/*\[\]()\r]""", r"""["\\\r]"""


def _lines_sql(code: str) -> str:
    pattern = code.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '{pattern}', ' ', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, l[i] AS x, i = len(l) AS last FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d))"""


def _wrapped(spark, d, code: str, forms) -> F.Column:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    lines = F.split(F.regexp_replace("text", code, " "), "\n")
    return docs.select("doc_id", F.array_join(F.transform(lines, forms), "\n").alias("body"))


_STORY_TEXT = f"CASE line % 4 WHEN 1 THEN x ELSE {_strip('x')} END"
_STORY_ROWS = r"FROM x WHERE line % 4 <> 3 AND regexp_matches(x, '\p{L}')"
_STORY_AT = "'passage[' || doc_id || '].line[' || line || '].seg[0]' || CASE line % 4 WHEN 1 THEN '.arg[0]' ELSE '' END"


def _stories(spark, d):
    """file, html: stories of a passage of text and a passage of code; lines are plain, a link's label, a shown argument, or a hidden one."""

    def form(x, i):
        kind = i % 4
        link = F.when(F.length(x) <= 900, F.concat(F.lit("[["), x, F.lit("|Home]]"))).otherwise(x)
        return F.when(kind == 0, x).when(kind == 1, F.concat(F.lit('<<link "'), x, F.lit('" "Gate">>'))).when(kind == 2, link).otherwise(F.concat(F.lit('<<set $x to "'), x, F.lit('">>')))

    docs = _wrapped(spark, d, _STORY_CODE, form)
    part = lambda name: F.concat(F.lit('<tw-passagedata pid="'), "doc_id", F.lit(f'" name="{name}" tags="">'), "body", F.lit("</tw-passagedata>"))
    return docs.select(F.col("doc_id").cast("string").alias("file"), F.concat(F.lit('<tw-storydata format="SugarCube">'), part("Text"), part("StoryInit")).alias("html"))


@query("story_texts", _lines_sql(_STORY_CODE) + f" SELECT CAST(doc_id AS VARCHAR) AS file, line, {_STORY_AT} AS json_path, {_STORY_TEXT} AS original {_STORY_ROWS}")
def story_texts(spark, d):
    return S.story_entries(_stories(spark, d)).select("file", "line", "json_path", "original")


def _shifted() -> F.Column:
    """Every third file has changed since its texts were taken out."""
    return F.col("file").cast("long") % 3 == 0


@query("story_round_trip", _lines_sql(_STORY_CODE) + f" SELECT CAST(doc_id AS VARCHAR) AS file, {_STORY_AT} AS json_path, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '~' END || {_STORY_TEXT} AS original {_STORY_ROWS}")
def story_round_trip(spark, d):
    """What is extracted after all texts were written back with a mark before them; texts that aren't as they were stay."""
    files = _stories(spark, d)
    found = S.story_entries(files).select("file", "json_path", "original", F.concat(F.lit("~"), "original").alias("translation"))
    edits = found.withColumn("original", F.when(_shifted(), F.concat("original", F.lit("!"))).otherwise(F.col("original")))
    out = W.patched(files.withColumnRenamed("html", "body"), edits, W.change_story)
    return S.story_entries(out.select("file", F.col("body").cast("string").alias("html"))).select("file", "json_path", "original")


@query("json_round_trip", f"{_ENTRIES} SELECT CAST(id >> 24 AS VARCHAR) AS file, '[' || (id & 16777215) || '].name' AS json_path, CASE WHEN (id >> 24) % 3 = 0 THEN '' ELSE '~' END || original AS original FROM e")
def json_round_trip(spark, d):
    """The same of JSON files, a document each, a record for each line."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    records = F.to_json(F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(x).alias("id"), x.alias("name"), F.lit("n").alias("note"))))
    files = docs.select(F.col("doc_id").cast("string").alias("file"), records.alias("body"))
    found = game_json.record_fields(files, ["name"]).withColumn("translation", F.concat(F.lit("~"), "original"))
    edits = found.withColumn("original", F.when(_shifted(), F.concat("original", F.lit("!"))).otherwise(F.col("original")))
    out = W.patched(files, edits, W.change_json)
    return game_json.record_fields(out.select("file", F.col("body").cast("string").alias("body")), ["name"]).select("file", "json_path", "original")


_LITERAL = rf"""(length({{0}}) BETWEEN 2 AND 4000 AND regexp_matches({{0}}, '\p{{{{L}}}}') AND NOT contains({{0}}, '://') AND NOT starts_with({{0}}, 'file:')
  AND NOT regexp_matches({{0}}, '(?i)\.(?:{"|".join(R.FILE_ENDINGS)})\s*$') AND NOT regexp_matches({{0}}, '^#[0-9a-fA-F]{{{{3,8}}}}\z')
  AND NOT (regexp_matches({{0}}, '^[A-Za-z0-9_]+\z') AND regexp_matches({{0}}, '[0-9]'))
  AND NOT (regexp_matches({{0}}, '^[A-Za-z_][A-Za-z0-9_]*\z') AND (length({{0}}) >= 12 OR (contains({{0}}, '_') AND length({{0}}) >= 8)))
  AND NOT regexp_matches({{0}}, '\b(?:sampler2D|uniform|varying|attribute)\b') AND NOT (contains({{0}}, ';') AND contains({{0}}, chr(10))))"""


@query(
    "script_texts",
    _lines_sql(_SCRIPT_CODE)
    + f""", k AS (
  SELECT 'game/' || doc_id || '.rpy' AS file, line, x, CASE line % 4 WHEN 0 THEN ':' || (line + 1) || ':dialogue' WHEN 1 THEN ':python:t' ELSE ':' || (line + 1) || ':choice' END AS place FROM x
  WHERE length({_strip('x')}) >= 2 AND CASE line % 4 WHEN 0 THEN length(x) + 9 - CAST(last AS INTEGER) <= 4000 WHEN 1 THEN {_LITERAL.format('x')} WHEN 3 THEN length(x) + 4 - CAST(last AS INTEGER) <= 4000 ELSE FALSE END
) SELECT x AS original, file, file || place AS context FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY file, line) AS r FROM k) WHERE r = 1""",
)
def script_texts(spark, d):
    """Scripts whose lines are dialogue, definitions, comments and choices; of equal texts the first has the place."""

    def form(x, i):
        kind = i % 4
        quoted = F.concat(F.lit('"'), x, F.lit('"'))
        return F.when(kind == 0, F.concat(F.lit("    e "), quoted)).when(kind == 1, F.concat(F.lit("define t = "), quoted)).when(kind == 2, F.concat(F.lit("# "), quoted)).otherwise(F.concat(quoted, F.lit(":")))

    docs = _wrapped(spark, d, _SCRIPT_CODE, form)
    files = docs.select(F.concat(F.lit("game/"), "doc_id", F.lit(".rpy")).alias("file"), "body")
    return R.script_entries(R.script_files(files)).select("original", "file", "context")


_NAME = "regexp_replace(original[1:CAST(4 + id % 12 AS BIGINT)], '[^A-Za-z0-9_]', '_', 'g')"


@query("py_text_candidate", f"{_ENTRIES} SELECT id, {_LITERAL.format('original')} AS line_is, {_LITERAL.format(_NAME)} AS name_is, {_LITERAL.format("(original || CASE id % 3 WHEN 0 THEN '.png' ELSE '' END)")} AS path_is FROM e")
def py_text_candidate(spark, d):
    """Of lines, of names made from their beginnings, and of lines that end like a file's name in turn."""
    name = F.regexp_replace(F.substring("original", F.lit(1), (4 + F.col("id") % 12).cast("int")), "[^A-Za-z0-9_]", "_")
    path = F.concat("original", F.when(F.col("id") % 3 == 0, ".png").otherwise(""))
    return entries(spark, d).select("id", R.is_literal_text(F.col("original")).alias("line_is"), R.is_literal_text(name).alias("name_is"), R.is_literal_text(path).alias("path_is"))


_PLACED = f"""{_ENTRIES}, s AS (
  SELECT id, context, original, row_number() OVER (ORDER BY context NULLS FIRST, id) - 1 AS place,
         CASE WHEN regexp_matches(original, '{X.WIDE}') THEN length(original) ELSE greatest(1, length(original) // 4) END AS n FROM e
), c AS (SELECT *, coalesce(context, '') AS g, sum(n) OVER (ORDER BY place) AS upto FROM s),
a AS (SELECT *, upto - n + 1501 AS need, max(place) OVER (PARTITION BY g) + 1 AS z FROM c),
f AS MATERIALIZED (
  SELECT a.place, least(greatest(coalesce(b.place, a.z), a.place + 1), a.place + 100, a.z) AS following
  FROM a ASOF LEFT JOIN c AS b ON b.g = a.g AND a.need <= b.upto
), r AS (
  WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS batch UNION ALL SELECT f.following, batch + 1 FROM r JOIN f ON f.place = r.start)
  SELECT start, batch FROM r WHERE start < (SELECT count(*) FROM s)
), b AS (SELECT c.*, r.batch FROM c ASOF JOIN r ON c.place >= r.start)"""


def _batched(spark, d):
    rows = entries(spark, d).select("id", "context", X.estimate_tokens(F.col("original")).alias("n"))
    return B.group_batches(rows, "context", "id", "n")


@query("language_batches", f"{_PLACED} SELECT id, batch FROM b")
def language_batches(spark, d):
    """Batches of up to 1,500 tokens and 100 lines over all lines of a language."""
    return _batched(spark, d).select("id", "batch")


_NEAR = "array_to_string(list(n.id ORDER BY n.place) FILTER ({0}), ' ')"


@query(
    "language_batch_context",
    f"{_PLACED}, w AS (SELECT batch, any_value(g) AS g, min(place) AS lo, max(place) AS hi FROM b GROUP BY batch) SELECT batch, coalesce({_NEAR.format('n.place < lo')}, '') AS before_ids, coalesce({_NEAR.format('n.place > hi')}, '') AS after_ids FROM w LEFT JOIN c AS n ON n.g = w.g AND (n.place BETWEEN lo - 3 AND lo - 1 OR n.place BETWEEN hi + 1 AND hi + 3) GROUP BY batch, lo, hi",
)
def language_batch_context(spark, d):
    """The three lines before and after each of these batches."""
    lines = entries(spark, d).select("id", "context", F.col("id").cast("string").alias("t"))
    out = B.batch_context(_batched(spark, d), lines, "context", "id", "t")
    return out.select("batch", F.array_join("before", " ").alias("before_ids"), F.array_join("after", " ").alias("after_ids"))


@query(
    "save_delta_fold",
    """
WITH e AS (SELECT user_id, event_id AS t, event_type AS k, CAST(trunc(value) AS BIGINT) AS v FROM events),
l AS (
  SELECT user_id, t, 'player.' || k AS path, CAST(v AS VARCHAR) AS value FROM e WHERE t % 5 = 0
  UNION ALL SELECT user_id, t, 'player.pos.x', CAST(t AS VARCHAR) FROM e WHERE t % 5 = 1
  UNION ALL SELECT user_id, t, 'player.pos.y', CAST(v AS VARCHAR) FROM e WHERE t % 5 = 1
  UNION ALL SELECT user_id, t, 'player.pos', CAST(t AS VARCHAR) FROM e WHERE t % 5 = 2
  UNION ALL SELECT user_id, t, 'player.pos.x', CAST(v AS VARCHAR) FROM e WHERE t % 5 = 3
  UNION ALL SELECT user_id, t, 'flags', '[' || t || ',1]' FROM e WHERE t % 5 = 3
  UNION ALL SELECT user_id, t, 'player', '7' FROM e WHERE t % 5 = 4 AND t % 7 = 0
  UNION ALL SELECT user_id, t, 'flags.' || k, 'true' FROM e WHERE t % 5 = 4 AND t % 7 <> 0
)
SELECT user_id, path, value FROM l WHERE NOT EXISTS (
  FROM l AS m WHERE m.user_id = l.user_id AND m.t > l.t AND (starts_with(m.path || '.', l.path || '.') OR starts_with(l.path || '.', m.path || '.'))
)""",
)
def save_delta_fold(spark, d):
    """Each user's events as differences of a tree: values within it, a value in place of a part of it, a list, and a value in place of all."""
    t, k, v = F.col("event_id"), F.col("event_type"), F.col("value").cast("long")
    tree = (
        F.when(t % 5 == 0, F.format_string('{"player":{"%s":%d}}', k, v))
        .when(t % 5 == 1, F.format_string('{"player":{"pos":{"x":%d,"y":%d}}}', t, v))
        .when(t % 5 == 2, F.format_string('{"player":{"pos":%d}}', t))
        .when(t % 5 == 3, F.format_string('{"flags":[%d,1],"player":{"pos":{"x":%d}}}', t, v))
        .when(t % 7 == 0, '{"player":7}')
        .otherwise(F.format_string('{"flags":{"%s":true}}', k))
    )
    out = saves.folded(table(spark, d, "events").select("user_id", "event_id", tree.alias("tree")), "user_id", "event_id", "tree")
    return out.select("user_id", F.array_join("path", ".").alias("path"), "value")


_UNESCAPED = "replace(replace(replace(replace(replace(original, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query("html_text")
def html_text(spark, d):
    """The texts of pages with their entities resolved."""
    out = M.html_segments(table(spark, d, "pages"))
    return out.select("page_id", "seg", S.unescape_html(F.col("original")).alias("text"))


_BEGINS = " OR ".join(f"starts_with(lower(ltrim(x)), '{w}')" for w in J.CODE_BEGINS)
_VALUES = ", ".join(f"'{v}'" for v in J.VALUES)


@query(
    "plugin_texts",
    _lines_sql(_SCRIPT_CODE)
    + f""", k AS (SELECT doc_id, trim(x) AS key FROM x WHERE line = 0), t AS (
  SELECT x.doc_id, line, x FROM x JOIN k ON k.doc_id = x.doc_id
  WHERE line % 2 = 0 AND x.doc_id % 4 <> 0 AND trim(x) <> key AND {_JS.format('x')} AND lower(trim(x)) NOT IN ({_VALUES}) AND NOT ({_BEGINS})
) SELECT 'js/plugins/p' || doc_id || '.js' AS file, '#plugin:' || (row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1) AS json_path, 'plugin p' || doc_id AS context, x AS original FROM t""",
)
def plugin_texts(spark, d):
    """Plugins whose lines are literals and comments in turn; the first line is the name of a parameter, and every fourth plugin is off."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    lines = F.split(F.regexp_replace("text", _SCRIPT_CODE, " "), "\n")
    form = lambda x, i: F.concat(F.when(i % 2 == 0, 'show("').otherwise('// "'), x, F.lit('");'))
    name = F.concat(F.lit("p"), "doc_id")
    files = docs.select(F.concat(F.lit("js/plugins/"), name, F.lit(".js")).alias("file"), F.array_join(F.transform(lines, form), "\n").alias("body"))
    plugin = F.struct(F.concat(name, F.lit(".js")).alias("name"), (F.col("doc_id") % 4 != 0).alias("status"), F.create_map(F.trim(F.get(lines, F.lit(0))), F.lit("1")).alias("parameters"))
    lists = docs.select(F.concat(F.lit("var $plugins =\n"), F.to_json(F.array(plugin)), F.lit(";")).alias("body"))
    return J.plugin_texts(files, J.enabled_plugins(lists))


@query("save_codec", "SELECT doc_id, md5(text) AS text_md5, true AS shorter FROM documents WHERE text IS NOT NULL AND length(text) > 2000")
def save_codec(spark, d):
    """Texts packed as saved games are, and unpacked."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND length(text) > 2000").select("doc_id", "text", L.lz_pack(F.col("text")).alias("packed"))
    return docs.select("doc_id", F.md5(L.lz_unpack(F.col("packed"))).alias("text_md5"), (F.length("packed") < 2 * F.octet_length("text")).alias("shorter"))


_CLOSED = "[\"''»”’)\\]}]"
_CUT = rf"regexp_replace(regexp_replace(original, '([.!?…]{_CLOSED}?)(\s)', '\1' || chr(1) || '\2', 'g'), '((?i:^|\s)(?i:{O._SHORT})\.)' || chr(1), '\1', 'g')"


@query("sentences", rf"{_ENTRIES}, c AS (SELECT id, list_filter(string_split({_CUT}, chr(1)), lambda s: s <> '') AS l FROM e) SELECT id, len(l) AS n, md5(array_to_string(l, '|')) AS cut FROM c")
def sentences(spark, d):
    """The lines' sentences."""
    rows = entries(spark, d).select("id", O.sentences(F.col("original"), "en").alias("l"))
    return rows.select("id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "|")).alias("cut"))


@query(
    "transliterate",
    f"{_ENTRIES}, w AS (SELECT id, original[1:1 + id % 4] AS w FROM e) SELECT id, CASE WHEN regexp_matches(w, '^[A-Za-z]{{1,3}}$') AND (length(w) = 1 OR NOT regexp_matches(w, '(?i)[aeiouy]') OR (length(w) = 2 AND w[1] = w[2]) OR (length(w) = 3 AND w[1] = w[2] AND w[2] = w[3])) THEN translate(w, '{O.LATIN}', '{O.CYRILLIC}') END AS word FROM w",
)
def transliterate(spark, d):
    """The lines' first letters, one to four of them."""
    word = F.substring("original", F.lit(1), (1 + F.col("id") % 4).cast("int"))
    return entries(spark, d).select("id", O.transliterated(word, "ru").alias("word"))


@query("offline_pipeline")
def offline_pipeline(spark, d):
    """Each different line with a model that sets a mark before each piece."""
    rows = entries(spark, d).groupBy("original").agg(F.min("id").alias("id"))
    return O.offline_translations(rows, lambda c: F.concat(F.lit("~"), c), "en", "xx", {"the": "THE"})


_FILE_KINDS = ("js/rmmz_core.js", "www/js/rpg_core.js", "game/a.rpy", "game/b.rpyc", "game/c.rpa", "renpy/x.py", "tyrano/t.js", "data/scenario/a.ks", "readme.txt")
_KIND_SQL = "CASE {0} " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_FILE_KINDS)) + " END"


@query(
    "engine_detect",
    f"""WITH f AS (
  SELECT doc_id AS game, {_KIND_SQL.format('doc_id % 9')} AS path FROM documents UNION ALL SELECT doc_id, {_KIND_SQL.format('doc_id // 9 % 9')} FROM documents
), p AS (SELECT game, list(path) AS l FROM f GROUP BY game), w AS (
  SELECT game, CASE WHEN list_contains(l, 'js/rmmz_core.js') THEN 100 WHEN list_contains(l, 'www/js/rpg_core.js') THEN 90 ELSE 0 END AS a,
         CASE WHEN list_contains(l, 'game/a.rpy') THEN 80 WHEN list_contains(l, 'game/b.rpyc') THEN 75 WHEN list_contains(l, 'game/c.rpa') THEN 70 WHEN list_contains(l, 'renpy/x.py') THEN 60 ELSE 0 END AS b,
         CASE WHEN list_contains(l, 'tyrano/t.js') THEN CASE WHEN list_contains(l, 'data/scenario/a.ks') THEN 95 ELSE 70 END WHEN list_contains(l, 'data/scenario/a.ks') THEN 80 ELSE 0 END AS d FROM p
) SELECT game, CASE WHEN greatest(a, b, d) = 0 THEN NULL WHEN a >= greatest(b, d) THEN 'rpgmaker' WHEN b >= d THEN 'renpy' ELSE 'tyrano' END AS engine, greatest(a, b, d) AS weight FROM w""",
)
def engine_detect(spark, d):
    """Each document stands for a game with two files, which its number says."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    kinds = F.array(*map(F.lit, _FILE_KINDS))
    pick = lambda n: F.get(kinds, (n % 9).cast("int"))
    paths = F.array(pick(F.col("doc_id")), pick(F.floor(F.col("doc_id") / 9)))
    files = docs.select(F.col("doc_id").alias("game"), F.explode(paths).alias("path"), F.lit(False).alias("packed"), F.lit(1).alias("size"), F.lit(None).cast("string").alias("head"))
    return G.detected_engine(files)


@query(
    "model_answers",
    "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN CASE WHEN len(l) = 1 THEN md5('[]') END ELSE md5(array_to_string(l, '|')) END AS texts FROM d",
)
def model_answers(spark, d):
    """Each document's lines as a model may give them back: a list within words, numbered lines, lines of JSON, a list that lacks one."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("l"))
    k, n = F.col("doc_id") % 4, F.size("l")
    numbered = F.array_join(F.reverse(F.transform("l", lambda x, i: F.to_json(F.struct(i.alias("i"), x.alias("t"))))), ",\n")
    # A text as JSON: the list of it, without the brackets.
    alone = F.array_join(F.transform("l", lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[|\]$", "")), "\n")
    content = F.when(k == 0, F.concat(F.lit("Here: "), F.to_json("l"), F.lit("\ndone"))).when(k == 1, numbered).when(k == 2, alone).otherwise(F.to_json(F.slice("l", F.lit(1), n - 1)))
    return docs.select("doc_id", F.md5(F.array_join(AN.translations_of(content, n), "|")).alias("texts"))
