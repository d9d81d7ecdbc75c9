"""Registered queries of masking, fixing, translating, glossaries and game state, with their SQL. The documents' lines hold no codes, so codes are set around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import codes as C
from lexloom.functions import text as X
from lexloom.operators import entries as E
from lexloom.operators import game_state as G
from lexloom.operators import translate as T
from lexloom.plans.catalog import _ENTRIES, _KNOWN_LINES, _SP, _SPOKEN, _blank, _lang, entries, known_lines, query, spoken, table
from lexloom.sources import game_files, game_json

_strip = lambda x: f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"
_q = lambda s: s.replace("'", "''")
_CODED = r"'\C[8]' || original || ' [name] [Два слова] %1 a\\b <b>'"


def coded(e):
    return F.concat(F.lit(r"\C[8]"), "original", F.lit(r" [name] [Два слова] %1 a\\b <b>"))


@query(
    "mask_code_list",
    f"{_ENTRIES}, c AS (SELECT id, list_filter(regexp_extract_all({_CODED}, '{_q(C.CODE)}'), lambda c: NOT starts_with(c, '[') OR c = '[[' OR (NOT regexp_matches(c, '{C.TEXT_SCRIPT}') AND (regexp_matches(c[2:-2], '{_q(C.CODE_HINT)}') OR regexp_matches(trim(c[2:-2]), '{C.IDENTIFIER}')))) AS l FROM e) SELECT id, array_to_string(l, ' ') AS codes, CAST(len(l) AS INTEGER) AS n FROM c",
)
def mask_code_list(spark, d):
    e = entries(spark, d)
    return e.select("id", C.mask_codes(coded(e))["codes"].alias("c")).select("id", F.array_join("c", " ").alias("codes"), F.size("c").alias("n"))


@query("tokens_valid", f"{_ENTRIES} SELECT id, true AS whole, false AS lost, false AS twice FROM e")
def tokens_valid(spark, d):
    """Of masked lines as they are, without a token, and with one twice."""
    e = entries(spark, d)
    m = e.select("id", C.mask_codes(coded(e)).alias("m"))
    valid = lambda t: X.tokens_valid(t, F.size("m.codes"))
    masked = F.col("m.masked")
    return m.select("id", valid(masked).alias("whole"), valid(F.replace(masked, F.lit("<x0/>"), F.lit(""))).alias("lost"), valid(F.concat(masked, F.lit("<x0/>"))).alias("twice"))


@query("token_guard", f"{_ENTRIES} SELECT id, CASE WHEN id % 3 = 0 THEN '<x1/>' || original || '<x0/>' ELSE CASE id % 3 WHEN 1 THEN '<x1/>' ELSE '</x1 >' END || lower(original) || '<x0/>' END AS guarded FROM e")
def token_guard(spark, d):
    """Of targets with the tokens swapped, the same, and the same in another form."""
    k, low = F.col("id") % 3, F.lower("original")
    target = F.when(k == 0, F.concat(F.lit("<x0/>"), low, F.lit("<x1/>"))).when(k == 1, F.concat(F.lit("<x1/>"), low, F.lit("<x0/>"))).otherwise(F.concat(F.lit("</x1 >"), low, F.lit("<x0/>")))
    return entries(spark, d).select("id", X.guard_tokens(F.concat(F.lit("<x1/>"), "original", F.lit("<x0/>")), target).alias("guarded"))


@query("var_safe", f"{_ENTRIES} SELECT id, id % 4 IN (0, 3) AS safe FROM e WHERE NOT regexp_matches(original, '[\\[\\]{{}}]')")
def var_safe(spark, d):
    """Groups kept, swapped, changed, and kept within others."""
    e, k = entries(spark, d).where(~F.col("original").rlike(r"[\[\]{}]")), F.col("id") % 4
    deep = "[1[2[3[4[5[6]]]]]]"
    source = F.concat(F.lit("[f(x['t'])] "), "original", F.lit(f" {{a}} {deep}"))
    target = F.when(k == 0, F.concat(F.lit("> "), source)).when(k == 1, F.concat(F.lit("{a} "), "original", F.lit(f" [f(x['t'])] {deep}"))).when(k == 2, F.replace(source, F.lit("6]"), F.lit("7]"))).otherwise(F.concat(F.lit("[f(x['t'])] {"), source, F.lit("}")))
    return e.select("id", X.variables_safe(source, target).alias("safe"))


_FIRST = "(original[1])"


@query("single_letter", rf"{_ENTRIES}, t AS (SELECT id, unnest([' ' || {_FIRST} || ' ', original, 'ホ', '私']) AS t FROM e) SELECT id, t, regexp_matches({_strip('t')}, '^{X.LETTERS}$') AS single FROM t")
def single_letter(spark, d):
    first = F.concat(F.lit(" "), F.substring("original", 1, 1), F.lit(" "))
    rows = entries(spark, d).select("id", F.explode(F.array(first, F.col("original"), F.lit("ホ"), F.lit("私"))).alias("t"))
    return rows.select("id", "t", X.is_single_letter(F.col("t")).alias("single"))


@query("resolve_src", f"{_SPOKEN} SELECT id, CASE WHEN {_lang('original')} IS DISTINCT FROM 'en' THEN coalesce({_lang('original')}, 'ja') END AS lang FROM s")
def resolve_src(spark, d):
    return spoken(entries(spark, d)).select("id", X.resolve_source(F.col("original"), "ja", "en").alias("lang"))


@query("fix_escape", rf"{_ENTRIES} SELECT id, '\C ' || original AS fixed, '\\C ' || original AS kept FROM e")
def fix_escape(spark, d):
    doubled = F.concat(F.lit(r"\\C "), "original")
    return entries(spark, d).select("id", X.fix_escape(F.col("original"), doubled).alias("fixed"), X.fix_escape(doubled, doubled).alias("kept"))


@query("fix_codes", rf"{_ENTRIES} SELECT id, ' ' || lower(original) || '[name]' AS fixed FROM e")
def fix_codes(spark, d):
    s, t = F.concat("original", F.lit("[name]")), F.concat(F.lit(r"[name]\V[1] "), F.lower("original"), F.lit("[name]"))
    return entries(spark, d).select("id", C.fix_codes(s, t).alias("fixed"))


@query("fix_numbers", f"{_ENTRIES} SELECT id, CASE id % 3 WHEN 0 THEN '② [3] ' WHEN 1 THEN '2 [3] ' ELSE '[3] ② 9 ' END || lower(original) AS circled, CASE id % 3 WHEN 0 THEN '-5 ' WHEN 1 THEN '5 7 ' ELSE '6 ' END || lower(original) AS signed FROM e WHERE NOT regexp_matches(original, '[0-9①-⑳\\[\\]{{}}]')")
def fix_numbers(spark, d):
    """A circled number lost, none in the source, one after a group; a lost sign, another count of numbers, another number."""
    e, k, low = entries(spark, d).where(~F.col("original").rlike(r"[0-9①-⑳\[\]{}]")), F.col("id") % 3, F.lower("original")
    circled = C.fix_circled(F.concat(F.when(k == 1, "2 ").otherwise("② "), "original"), F.concat(F.when(k == 2, "[3] 2 9 ").otherwise("2 [3] "), low))
    signed = C.fix_signs(F.concat(F.lit("-5 "), "original"), F.concat(F.when(k == 0, "5 ").when(k == 1, "5 7 ").otherwise("6 "), low))
    return e.select("id", circled.alias("circled"), signed.alias("signed"))


@query("fix_punctuation", rf"{_ENTRIES} SELECT id, regexp_replace(replace(replace(original, '. ', '.'), ', ', ','), '([.,])([^{_q(C.NO_GAP)}])', '\1 \2', 'g') AS fixed FROM e")
def fix_punctuation(spark, d):
    """Wide marks in place of full stops and commas, and back: a space follows before a word only."""
    e = entries(spark, d)
    bare = F.replace(F.replace("original", F.lit(". "), F.lit(".")), F.lit(", "), F.lit(","))
    return e.select("id", C.fix_punctuation(F.translate(bare, ".,", "。，"), "ru").alias("fixed"))


@query("length_guard", f"{_ENTRIES} SELECT id, CASE WHEN 10 * length(original) > greatest(8 * length(original), 20) THEN original ELSE repeat(original, 10) END AS guarded FROM e")
def length_guard(spark, d):
    return entries(spark, d).select("id", X.guard_length(F.col("original"), F.repeat("original", 10)).alias("guarded"))


_W = r"regexp_extract_all(original, '[\p{L}\p{N}_]+')"


@query(
    "suspicious",
    rf"{_ENTRIES}, w AS (SELECT id, list_transform({_W}, lambda x: lower(x)[1:5]) AS s FROM e), c AS (SELECT id, sum(n) AS n, coalesce(sum(n) FILTER (n > 1), 0) AS r FROM (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(s) AS x FROM w) GROUP BY id, x) GROUP BY id) "
    r"SELECT e.id, length(original) > 6 AS low, (length(original) > 3 AND coalesce(n, 0) >= 4 AND CAST(r AS DOUBLE) / n > 0.25) OR length(regexp_replace(original, '[^A-Za-z]', '', 'g')) < 0.5 * length(regexp_replace(original, '[^\p{L}]', '', 'g')) AS odd FROM e LEFT JOIN c ON c.id = e.id",
)
def suspicious(spark, d):
    """By a low score alone, and without one."""
    t = F.col("original")
    rows = entries(spark, d).withColumn("odd", X.suspicious(t, "en", F.lit(0.0)))
    return rows.select("id", (X.suspicious(t, "xx", F.lit(-2.0)) & (F.length(t) > 6)).alias("low"), "odd")


_JS = r"length({0}) BETWEEN 2 AND 400 AND regexp_matches({0}, '\p{{L}}') AND (regexp_matches({0}, '[\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}]') OR (regexp_matches({0}, '\s') AND NOT regexp_matches({0}, '[\\/]') AND NOT regexp_matches({0}, '^(http|www\.|[=:<])')))"
_JS_FORM = "(CASE id % 4 WHEN 0 THEN original WHEN 1 THEN replace(original, ' ', '/') WHEN 2 THEN '=' || original ELSE 'ツ' || replace(original, ' ', '/') END)"


@query("js_text_candidate", f"{_ENTRIES} SELECT id, {_JS.format('original')} AS line_is, {_JS.format(_JS_FORM)} AS form_is FROM e")
def js_text_candidate(spark, d):
    """Of lines, and of lines in turn as they are, as paths, as expressions and as paths with a kana."""
    k, slashed = F.col("id") % 4, F.replace("original", F.lit(" "), F.lit("/"))
    form = F.when(k == 0, F.col("original")).when(k == 1, slashed).when(k == 2, F.concat(F.lit("="), "original")).otherwise(F.concat(F.lit("ツ"), slashed))
    return entries(spark, d).select("id", game_json.js_text(F.col("original")).alias("line_is"), game_json.js_text(form).alias("form_is"))


def term_table(spark, d):
    """A glossary of the words that part names use."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term")).where("term <> ''").distinct()
    return words.select(F.lit("en").alias("src"), F.lit("ru").alias("tgt"), "term", F.concat(F.lit("<"), F.upper("term"), F.lit(">")).alias("tr"))


_TERMS = "t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)"


@query("glossary_route_semi", f"{_ENTRIES}, {_TERMS} SELECT id FROM e WHERE EXISTS (SELECT 1 FROM t WHERE term <> '' AND contains(original, term))")
def glossary_route_semi(spark, d):
    e = entries(spark, d)
    return e.join(E.glossary_matches(e, term_table(spark, d), "id", "original").select("id").distinct(), "id", "left_semi").select("id")


@query("glossary_segments", "SELECT p_partkey, i AS pos, part, CASE WHEN i % 2 = 0 THEN '<' || upper(part) || '>' END AS fixed FROM (SELECT p_partkey, unnest(range(0, 3)) AS i, unnest([split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2)]) AS part FROM part)")
def glossary_segments(spark, d):
    part = table(spark, d, "part")
    texts = part.select(F.lit("en").alias("lang"), F.col("p_name").alias("original")).distinct()
    cut = T.matched_terms(texts, term_table(spark, d)).select("original", F.posexplode(C.glossary_segments(F.col("original"), F.col("terms"))).alias("pos", "s"))
    return part.join(cut, part["p_name"] == cut["original"]).select("p_partkey", F.col("pos").cast("long").alias("pos"), "s.part", "s.fixed")


@query("longest_term_first", "SELECT term, CAST(length(term) AS INTEGER) AS n, row_number() OVER (ORDER BY length(term) DESC, term) AS place FROM (SELECT DISTINCT p_type AS term FROM part) WHERE term <> ''")
def longest_term_first(spark, d):
    from pyspark.sql import Window

    # One row for each kind of part.
    terms = table(spark, d, "part").select(F.col("p_type").alias("term")).where("term <> ''").distinct()
    return terms.select("term", F.length("term").alias("n"), F.row_number().over(Window.orderBy(F.desc(F.length("term")), "term")).cast("long").alias("place"))


def raw_terms(spark, d):
    value = F.when(F.col("p_size") > 25, F.to_json(F.struct(F.upper("p_name").alias("tr"), F.col("p_brand").alias("group")))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.lit("en->ru").alias("pair"), F.concat("p_name", F.lit("#"), "p_partkey").alias("term"), value.alias("value"), F.col("p_partkey").alias("ord"))


_NORMAL = "n AS (SELECT 'en' AS src, 'ru' AS tgt, p_name || '#' || p_partkey AS term, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS tr, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS grp, p_partkey AS ord FROM part)"


@query("glossary_terms", f"WITH {_NORMAL} SELECT * FROM n")
def glossary_terms(spark, d):
    return T.normal_terms(raw_terms(spark, d))


@query("glossary_groups", f"WITH {_NORMAL} SELECT grp, min(ord) AS first FROM n WHERE grp <> '' GROUP BY grp")
def glossary_groups(spark, d):
    return T.term_groups(T.normal_terms(raw_terms(spark, d)))


@query("glossary_search", f"WITH {_NORMAL} SELECT term FROM n WHERE grp = 'Brand#13' AND contains(lower(tr), 'widget')")
def glossary_search(spark, d):
    return T.term_search(T.normal_terms(raw_terms(spark, d)), "Brand#13", "WIDGET").select("term")


@query("glossary_set", f"WITH {_NORMAL} SELECT src, tgt, term, 'new' AS tr, grp, ord FROM n UNION ALL SELECT 'en', 'ru', 'fresh', 'new', '', -1")
def glossary_set(spark, d):
    old = T.normal_terms(raw_terms(spark, d))
    new = old.select("src", "tgt", "term", F.lit("new").alias("tr"), "ord").union(old.select("src", "tgt", F.lit("fresh"), F.lit("new"), F.lit(-1).cast("long")).distinct())
    return T.set_terms(old, new)


@query("term_filter", f"{_ENTRIES}, p AS (SELECT original AS term, translation AS trans FROM e) SELECT term, trans FROM p WHERE term <> '' AND trans <> '' AND length(term) <= 40 AND term <> trans")
def term_filter(spark, d):
    return T.good_terms(entries(spark, d).select(F.col("original").alias("term"), F.col("translation").alias("trans")), "en")


def coded_entries(spark, d):
    """Lines with codes around them, and every seventh a path."""
    line = F.concat(F.lit(r"\C[8]"), "original", F.lit(" [name] %1"))
    return entries(spark, d).withColumn("original", F.when(F.col("id") % 7 == 0, F.concat(F.lit("img/a"), "id", F.lit(".png"))).otherwise(line))


_CODED_ENTRIES = _ENTRIES + r", x AS (SELECT id, file, json_path, context, CASE WHEN id % 7 = 0 THEN 'img/a' || id || '.png' ELSE '\C[8]' || original || ' [name] %1' END AS original, translation, status FROM e)"


@query(
    "translate_pipeline",
    rf"{_CODED_ENTRIES}, tm AS ({_KNOWN_LINES.replace('FROM e', 'FROM x')}), y AS (SELECT x.*, {_blank('translation')} AND status <> 'skip' AS mine, CASE WHEN target IS NOT NULL THEN target WHEN id % 7 = 0 THEN original ELSE '\C[8]~' || substr(original, 6) END AS new FROM x LEFT JOIN tm ON source = original) "
    "SELECT id, file, json_path, context, original, CASE WHEN mine THEN new ELSE translation END AS translation, CASE WHEN mine THEN 'translated' ELSE status END AS status FROM y",
)
def translate_pipeline(spark, d):
    """The engine sets a mark before each text; codes at the edges, masks, paths and the translation memory stand in its way."""
    e = coded_entries(spark, d)
    return T.translate_entries(e, "ru", lambda t: F.concat(F.lit("~"), t), memory=known_lines(e))


@query("translate_names", "SELECT p_partkey, '<' || upper(split_part(p_name, ' ', 1)) || '> <' || upper(split_part(p_name, ' ', 2)) || '>' AS name FROM part")
def translate_names(spark, d):
    """Names whose words are all glossary terms never reach the engine."""
    part = table(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.lit("f").alias("file"), F.lit("").alias("json_path"), F.lit("").alias("context"), F.col("p_name").alias("original"), F.lit("").alias("translation"), F.lit("new").alias("status"))
    out = T.translate_entries(rows, "ru", lambda t: F.concat(F.lit("!"), t), glossary=term_table(spark, d))
    return out.select(F.col("id").alias("p_partkey"), F.col("translation").alias("name"))


@query("corrections", f"{_ENTRIES} SELECT id, translation AS old_text, {_strip('translation')} || ' [fixed]' AS new_text FROM e WHERE NOT {_blank('translation')} AND status IN ('translated', 'manual')")
def corrections(spark, d):
    return T.corrections(entries(spark, d), lambda original, draft: F.concat(X.stripped(draft), F.lit(" [fixed]")))


@query("corrections_accepted", f"{_ENTRIES} SELECT id, file, json_path, context, original, CASE WHEN NOT {_blank('translation')} AND status IN ('translated', 'manual') THEN {_strip('translation')} || '!' ELSE translation END AS translation, CASE WHEN NOT {_blank('translation')} AND status IN ('translated', 'manual') THEN 'corrected' ELSE status END AS status FROM e")
def corrections_accepted(spark, d):
    e = entries(spark, d)
    diffs = T.corrections(e, lambda original, draft: F.concat(X.stripped(draft), F.lit("!")))
    return E.update_by_id(e, diffs.select("id", F.lit(1).alias("ord"), F.col("new_text").alias("translation")), "corrected")


@query("dashboard_stats", f"{_ENTRIES} SELECT count(*) FILTER (NOT {_blank('translation')}) AS done, count(*) FILTER ({_blank('translation')}) AS remaining, count(*) AS total FROM e")
def dashboard_stats(spark, d):
    return E.dashboard(entries(spark, d))


_HALF_DONE = f"{_ENTRIES}, h AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN '' ELSE translation END AS translation) FROM e)"


@query("worker_counters", f"{_HALF_DONE} SELECT count(*) FILTER (status = 'translated') AS translated, count(*) FILTER (status = 'skip' AND {_blank('translation')}) AS skipped FROM h")
def worker_counters(spark, d):
    return E.worker_counters(entries(spark, d).withColumn("translation", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("translation"))))


@query("file_order", f"{_SPOKEN}, l AS (SELECT file, {_lang('original')} AS lang, row_number() OVER (PARTITION BY file ORDER BY id) AS r FROM s), t AS (SELECT file, coalesce(bool_and(lang = 'en') FILTER (r <= 40), false) AS is_target FROM l GROUP BY file) SELECT file, CAST(row_number() OVER (ORDER BY is_target, file) AS INTEGER) AS place FROM t")
def file_order(spark, d):
    return E.file_order(spoken(entries(spark, d)), "en")


@query("table_page", f"{_ENTRIES} SELECT id, original FROM e ORDER BY id LIMIT 10000")
def table_page(spark, d):
    """What a table shows: its first 10,000 rows."""
    return E.table_page(entries(spark, d)).select("id", "original")


@query("file_sizes", f"{_ENTRIES} SELECT file, count(*) AS n, CAST(sum(length(original)) AS BIGINT) AS chars, CAST(sum(length(translation)) AS BIGINT) AS translated_chars FROM e GROUP BY file")
def file_sizes(spark, d):
    return E.sizes(entries(spark, d))


@query("dedup_holder_rows", f"{_ENTRIES}, w AS (SELECT id, original, {_lang('original')} AS lang FROM e WHERE {_blank('translation')} AND status <> 'skip') SELECT id, min(id) OVER (PARTITION BY lang, original) AS first_id FROM w WHERE lang IS NOT NULL AND lang <> 'ru'")
def dedup_holder_rows(spark, d):
    return E.holder_rows(entries(spark, d), "ru")


@query("plugin_key_anti", f"{_ENTRIES}, k AS ({_KNOWN_LINES}) SELECT id, original FROM e WHERE original NOT IN (SELECT source FROM k)")
def plugin_key_anti(spark, d):
    e = entries(spark, d)
    return E.not_among(e.select("id", "original"), known_lines(e).select(F.col("source").alias("original")), "original")


@query("status_cycle", f"{_ENTRIES} SELECT id, CASE status WHEN 'skip' THEN 'empty' WHEN 'translated' THEN 'empty' WHEN 'corrected' THEN 'empty' WHEN 'manual' THEN 'done' ELSE 'draft' END AS state FROM e")
def status_cycle(spark, d):
    return entries(spark, d).select("id", X.next_state(X.state_of(F.col("status"))).alias("state"))


@query("display_name", "SELECT c_custkey AS idx, CASE WHEN s_name IS NULL THEN c_name ELSE s_name || ' · ' || c_name END AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT n_nationkey, n_name FROM nation")
def display_name(spark, d):
    side = lambda t, i, n: table(spark, d, t).select(F.col(i).cast("long").alias("idx"), F.col(n).alias("name"))
    c, s, n = side("customer", "c_custkey", "c_name"), side("supplier", "s_suppkey", "s_name"), side("nation", "n_nationkey", "n_name")
    return G.display_names(c.select("idx").union(n.select("idx")).distinct(), c, s, n)


@query("variable_view", "SELECT event_id FROM events WHERE contains(CAST(value AS VARCHAR), '7') AND event_type IN ('click', 'error')")
def variable_view(spark, d):
    rows = table(spark, d, "events").select("event_id", F.lit("").alias("name"), F.when(F.col("event_type").isin("click", "error"), "bool").when(F.col("event_type") == "signup", "text").otherwise("float").alias("kind"), "value")
    return G.variable_view(rows, want_bool=True, hide_text=True, search="7").select("event_id")


@query("coerced", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS whole, false AS flag FROM lineitem")
def coerced(spark, d):
    rows = table(spark, d, "lineitem").withColumn("t", F.concat(F.lit(" "), F.col("l_quantity").cast("long").cast("string")))
    return rows.select("l_orderkey", "l_linenumber", G.coerced(F.lit("int"), F.col("t"))["value"].alias("whole"), G.coerced(F.lit("bool"), F.lit("maybe"))["ok"].alias("flag"))


@query("event_at", "SELECT c_custkey, c_nationkey AS x, e.id FROM customer LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS id FROM supplier GROUP BY s_nationkey) e ON s_nationkey = c_nationkey")
def event_at(spark, d):
    events = table(spark, d, "supplier").select(F.col("s_nationkey").alias("x"), F.lit(0).alias("y"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"))
    return G.first_at(events, table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("x"), F.lit(0).alias("y"))).select("c_custkey", "x", "id")


@query("next_id", "SELECT max(event_id) + 1 AS next_id FROM events")
def next_id(spark, d):
    return G.next_id(table(spark, d, "events").select(F.col("event_id").alias("id")))


@query("command_name", "SELECT c_custkey AS id, c_nationkey + 5 AS code, coalesce(n_name, 'Command ' || (c_nationkey + 5)) AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 5")
def command_name(spark, d):
    commands = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 5).alias("code"))
    return G.command_names(commands, table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")))


@query("map_search", "SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '12') OR c_custkey = 12")
def map_search(spark, d):
    return G.map_search(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), " 12 ").select("id")


@query("fixed_batches", "SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 8 AS INTEGER) AS batch FROM conversations")
def fixed_batches(spark, d):
    return G.fixed_batches(table(spark, d, "conversations"), ["conv_id"], "turn", 8).select("conv_id", "turn", "batch")


@query("distinct_until_changed", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR event_type IS DISTINCT FROM before")
def distinct_until_changed(spark, d):
    return G.distinct_until_changed(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query(
    "tile_class",
    "SELECT l_orderkey, l_linenumber, t, CASE WHEN t <= 0 OR t >= 8192 THEN NULL WHEN t < 256 THEN 'B' WHEN t < 512 THEN 'C' WHEN t < 768 THEN 'D' WHEN t < 1024 THEN 'E' WHEN t < 1536 THEN '' WHEN t < 2048 THEN 'A5' WHEN t < 2816 THEN 'A1' WHEN t < 4352 THEN 'A2' WHEN t < 5888 THEN 'A3' ELSE 'A4' END AS sheet, "
    "CASE WHEN t > 0 AND t < 1536 THEN ((t % 256) // 128 % 2 * 8 + t % 8) * 48 WHEN t BETWEEN 1536 AND 2047 THEN (t - 1536) % 8 * 48 END AS x, CASE WHEN t > 0 AND t < 1536 THEN (t % 256) // 8 % 16 * 48 WHEN t BETWEEN 1536 AND 2047 THEN (t - 1536) // 8 * 48 END AS y, "
    "CASE WHEN t BETWEEN 2048 AND 8191 THEN (t - 2048) // 48 END AS kind, CASE WHEN t BETWEEN 2048 AND 8191 THEN (t - 2048) % 48 END AS shape FROM (SELECT *, CAST(l_extendedprice * 100 % 9000 AS INTEGER) AS t FROM lineitem)",
)
def tile_class(spark, d):
    rows = table(spark, d, "lineitem").withColumn("t", F.rint(F.col("l_extendedprice") * 100 % 9000).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", "t", G.tile_class(F.col("t")).alias("c")).select("l_orderkey", "l_linenumber", "t", "c.sheet", "c.x", "c.y", "c.kind", "c.shape")


@query(
    "map_layers",
    "SELECT o_orderkey, array_to_string(f[1:2 * n], ' ') AS lower, array_to_string(f[2 * n + 1:4 * n], ' ') AS upper, array_to_string(f[4 * n + 1:5 * n], ' ') AS shadow, CASE WHEN k = 6 THEN array_to_string(f[5 * n + 1:6 * n], ' ') ELSE '' END AS region FROM (SELECT o_orderkey, 4 AS n, k, range(0, 4 * k) AS f FROM (SELECT o_orderkey, 5 + CAST(o_orderkey % 2 AS INTEGER) AS k FROM orders))",
)
def map_layers(spark, d):
    """Maps of four cells with five or six layers."""
    layers = (5 + F.col("o_orderkey") % 2).cast("int")
    rows = table(spark, d, "orders").select("o_orderkey", G.map_layers(F.sequence(F.lit(0), 4 * layers - 1), F.lit(4)).alias("m"))
    return rows.select("o_orderkey", *[F.array_join(f"m.{c}", " ").alias(c) for c in ("lower", "upper", "shadow", "region")])



@query(
    "game_texts",
    "SELECT 'data/' || p_partkey || '/Items.json' AS file, '[1].' || f AS json_path, 'Items ''' || p_name || '''' AS context, t AS original FROM (SELECT p_partkey, p_name, unnest(['name', 'description']) AS f, unnest([p_name, p_type]) AS t FROM part) "
    "UNION ALL SELECT 'data/' || s_suppkey || '/Map001.json', p, c, t FROM (SELECT s_suppkey, unnest(['displayName', 'events[1].name', 'events[1].pages[0].list[0].parameters[0]', 'events[1].pages[0].list[1].parameters[0][1]']) AS p, "
    "unnest(['map name', 'Map001 event name', 'Map001 event ''Door'' p.1 / dialog', 'Map001 event ''Door'' p.1 / choice']) AS c, unnest([s_name, 'Door', 'I am ' || s_name, s_name || '?']) AS t FROM supplier) "
    "UNION ALL SELECT 'data/' || c_custkey || '/Own.json', 'a.l[1].t', 'file Own.json', 'sold to ' || c_mktsegment FROM customer",
)
def game_texts(spark, d):
    """Databases of the parts, maps of the suppliers, and files of another name of the customers."""
    named = lambda key, name: F.concat(F.lit("data/"), key, F.lit(f"/{name}")).alias("file")
    text = lambda *c: F.to_json(F.struct(*c))
    item = text(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.lit("not looked at").alias("note"))
    items = table(spark, d, "part").select(named("p_partkey", "Items.json"), F.concat(F.lit("[null,"), item, F.lit("]")).alias("body"))
    name = F.col("s_name")
    said = text(F.lit(401).alias("code"), F.array(F.concat(F.lit("I am "), name)).alias("parameters"))
    asked = text(F.lit(102).alias("code"), F.array(F.array(F.lit(""), F.concat(name, F.lit("?")))).alias("parameters"))
    page = F.concat(F.lit('{"displayName":"'), name, F.lit('","events":[null,{"name":"Door","pages":[{"list":['), said, F.lit(","), asked, F.lit("]}]}]}"))
    maps = table(spark, d, "supplier").select(named("s_suppkey", "Map001.json"), page.alias("body"))
    listed = F.array(F.struct(F.lit("k").alias("t")), F.struct(F.concat(F.lit("sold to "), "c_mktsegment").alias("t")))
    own = table(spark, d, "customer").select(named("c_custkey", "Own.json"), text(F.struct(listed.alias("l")).alias("a"), F.struct(F.lit("not this one").alias("x")).alias("note")).alias("body"))
    return game_files.game_texts(items.unionByName(maps).unionByName(own))


@query("flat_paths", "SELECT c_custkey, unnest(['name', 'sub.l[0]', 'sub.l[1]', 'sub.none']) AS path, unnest([c_name, CAST(c_custkey AS VARCHAR), c_mktsegment, '[]']) AS value FROM customer")
def flat_paths(spark, d):
    inner = F.struct(F.array(F.col("c_custkey").cast("string"), F.col("c_mktsegment")).alias("l"), F.array().cast("array<string>").alias("none"))
    rows = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), inner.alias("sub"))).alias("body"))
    return game_json.flat_paths(rows, "c_custkey", "body")


_ESCAPED = r"""replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(13), '\n'), chr(9), '\t')"""


@query("string_pairs", f"{_ENTRIES} SELECT file, id, sha1(original)[1:12] AS tag, {_ESCAPED.format('original')} AS old, {_ESCAPED.format('translation')} AS new FROM (SELECT *, row_number() OVER (PARTITION BY original ORDER BY id) AS k FROM e WHERE NOT {_blank('translation')} AND status <> 'skip') WHERE k = 1")
def string_pairs(spark, d):
    return E.string_pairs(entries(spark, d))


@query("string_counts", f"{_ENTRIES}, o AS (SELECT DISTINCT original FROM e WHERE NOT {_blank('translation')} AND status <> 'skip'), k AS (SELECT DISTINCT original FROM e WHERE file = (SELECT min(file) FROM e)) SELECT count(*) AS strings, count(*) FILTER (k.original IS NULL) AS new_strings FROM o LEFT JOIN k ON k.original = o.original")
def string_counts(spark, d):
    """Against the texts of the first file as those of the last run."""
    e = entries(spark, d)
    least = e.agg(F.min("file").alias("file"))
    known = e.join(F.broadcast(least), "file", "left_semi").select(X.escape_literal(F.col("original")).alias("old"))
    return E.string_counts(E.string_pairs(e), known)


@query("escape_round_trip", rf"""{_ENTRIES} SELECT id, '\\\"' || {_ESCAPED.format('original')} || '\n\n' AS escaped, NOT contains(original, chr(13)) AS same FROM e""")
def escape_round_trip(spark, d):
    """A backslash, a quote and two line ends around each line; carriage returns come back as line feeds."""
    around = lambda ends: F.concat(F.lit('\\"'), "original", F.lit(ends))
    escaped = X.escape_literal(around("\r\n\n"))
    return entries(spark, d).select("id", escaped.alias("escaped"), (X.unescape_literal(escaped) == around("\n\n")).alias("same"))


@query("escape_html", f"{_ENTRIES} SELECT id, '&lt;b&gt;' || replace(replace(replace(original, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' &amp;amp;' AS escaped FROM e")
def escape_html(spark, d):
    return entries(spark, d).select("id", X.escape_html(F.concat(F.lit("<b>"), "original", F.lit(" &amp;"))).alias("escaped"))


@query("term_groups", "SELECT p_brand AS grp, CAST(row_number() OVER (ORDER BY min(p_partkey), p_brand) AS INTEGER) AS place FROM part GROUP BY p_brand")
def term_groups(spark, d):
    return E.term_groups(table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("grp")))
