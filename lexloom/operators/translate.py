"""Translating entries with a pluggable engine, corrections of translations, and terms.

An engine is a function from a column of masked texts to a column of their translations (a pandas UDF that calls a model or a
service, or an expression), or Batches: a function from a batch of texts and the lines around it to their translations. It
sees each text of a language once, and texts without words never. Its answers are written before they are used, so nothing that
follows asks again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import codes as C
from lexloom.functions import text as X
from lexloom.functions.shared import stored
from lexloom.operators import batches as B
from lexloom.operators import entries as E


class Batches(NamedTuple):
    """An engine that is asked batch by batch: ask(texts, before, after) gives as many translations, before and after being the lines around the batch. An error, or another number of answers, leaves its texts as they are."""

    ask: Callable[[list[str], list[str], list[str]], list[str]]
    tokens: int = 1500
    lines: int = 100
    context: int = 3


Engine = Callable[[Column], Column] | Batches
#: Statuses that a text without a language to translate from keeps.
KEPT = ("manual", "corrected", "translated")
WIDE_SOURCES, WIDE_TERM = ("ja", "zh", "ko"), "[぀-ヿ一-鿿가-힯]"


def asked(rows: DataFrame, engine: Engine, text: str, lines: DataFrame | None = None) -> DataFrame:
    """rows with out, the engine's answers for the column text, written once. Batches need lang and first_id, and lines (lang, id, original) for the context."""
    if not isinstance(engine, Batches):
        return stored(rows.withColumn("out", engine(F.col(text))), "answers")
    sized = rows.withColumn("n__", X.estimate_tokens(F.col(text)))
    made = stored(B.group_batches(sized, "lang", "first_id", "n__", engine.tokens, engine.lines).drop("n__"), "batches")
    if lines is None:
        lines = rows.select("lang", F.col("first_id").alias("id"), F.col(text).alias("original"))
    around = B.batch_context(made.select("batch", "lang", F.col("first_id").alias("id")), lines, "lang", "id", "original", engine.context)
    narrow = made.select("batch", "lang", "first_id", F.col(text).alias("asked")).join(around, "batch")
    ask = engine.ask

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("first_id")
        texts = table["asked"].to_pylist()
        try:
            out = list(ask(texts, table["before"][0].as_py(), table["after"][0].as_py()))
        except Exception:
            out = texts
        # What failed or was lost stays as it is.
        return table.select(["lang", "first_id"]).append_column("out", pa.array(out if len(out) == len(texts) else texts, pa.string()))

    answers = narrow.groupBy("batch").applyInArrow(run, "lang string, first_id long, out string")
    return stored(made.drop("batch").join(answers, ["lang", "first_id"]), "answers")


def matched_terms(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """texts (lang, original) with terms, those of its language's glossary (src, term, tr) that it contains; only texts that have one."""
    rows = texts.withColumn("key", F.struct(F.xxhash64("lang", "original").alias("h"), F.crc32(F.col("original").cast("binary")).alias("c"), F.length("original").alias("n")))
    found = E.glossary_matches(rows, glossary.select("term"), "key", "original").distinct()
    own = found.join(glossary.select("src", "term", "tr"), "term").groupBy("key").agg(F.collect_set(F.struct("src", "term", "tr")).alias("all"))
    got = rows.join(own, "key").withColumn("terms", F.transform(F.filter("all", lambda t: t["src"] == F.col("lang")), lambda t: F.struct(t["term"].alias("term"), t["tr"].alias("tr"))))
    return got.where(F.size("terms") > 0).drop("key", "all")


def _set_apart(texts: DataFrame) -> DataFrame:
    """texts with e, the codes at the edges, m, the masked middle, and as_is: texts that no engine gets. Written once, as each filter on as_is would work all of it out again."""
    original = F.col("original")

    def as_is(masked: Column) -> Column:
        return C.is_code_only(masked) | ~X.has_letter(original) | X.is_code_token(masked) | X.is_code_token(original) | X.is_single_letter(masked)

    def parted(e: Column) -> Column:
        return X.once(C.mask_codes(e["middle"]), lambda m: F.struct(e.alias("e"), m.alias("m"), as_is(m["masked"]).alias("as_is")))

    return stored(texts.withColumn("s__", X.once(C.split_edges(original), parted)), "set_apart").select(*texts.columns, "s__.*")


def with_engine(texts: DataFrame, engine: Engine, target: str, lines: DataFrame | None = None) -> DataFrame:
    """texts (lang, original; for Batches first_id) with text: codes masked, edges set aside, the engine's answer checked, unmasked and mended. Only an answer that lost a code is asked for again, for the whole text."""
    split = _set_apart(texts).withColumn("masked", F.col("m.masked"))
    out = asked(split.where("NOT as_is"), engine, "masked", lines)
    codes, original = F.col("m.codes"), F.col("original")
    whole = X.tokens_valid(F.col("out"), F.size(codes))
    good = out.where(F.coalesce(whole, F.lit(False))).withColumn("back", C.unmask_codes(F.col("out"), codes))
    lost = asked(out.where(~F.coalesce(whole, F.lit(False))).drop("out"), engine, "original", lines).withColumn("back", F.col("out"))
    back = good.select("lang", "original", "e", "back").unionByName(lost.select("lang", "original", "e", "back"))
    # Each step uses what the one before gives in several places.
    full = X.once(F.col("back"), lambda b: F.when(X.is_blank(b), original).otherwise(b))
    joined = X.once(full, lambda t: C.reattach(t, F.col("e.lead"), F.col("e.trail")))
    answered = back.select("lang", "original", X.once(joined, lambda t: C.apply_fixers(original, t, target)).alias("text"))
    return answered.unionByName(split.where("as_is").select("lang", "original", original.alias("text")))


def by_segments(texts: DataFrame, engine: Engine, target: str) -> DataFrame:
    """texts (lang, original, terms) with text: terms take their fixed translation, what is between goes to the engine, each different part once. A single letter, what has no letter, an address and a path stay as they are."""
    split = _set_apart(texts)
    as_it_is = X.is_single_letter(F.col("original")) | ~X.has_letter(F.col("original")) | X.is_code_token(F.col("original"))
    rows = split.where(~as_it_is).select("lang", "original", "e", "m.codes", F.posexplode(C.glossary_segments(F.col("m.masked"), F.col("terms"))).alias("pos", "s"))
    part = F.col("s.part")
    rows = rows.withColumn("bare", X.stripped(part))
    kept = F.col("s.fixed").isNotNull() | (F.col("bare") == "") | C.is_code_only(F.col("bare")) | X.is_single_letter(F.col("bare"))
    rows = stored(rows.withColumn("as_is", kept), "parts")
    wanted = rows.where("NOT as_is").groupBy("lang", "bare").agg(F.min(F.xxhash64("original", "pos")).alias("first_id"))
    out = asked(wanted, engine, "bare").select("lang", "bare", "out")
    rows = rows.join(out, ["lang", "bare"], "left")
    got = C.unmask_codes(F.when(X.is_blank(F.col("out")), F.col("bare")).otherwise(F.col("out")), F.col("codes"))
    rows = rows.withColumn("got", C.apply_fixers(C.unmask_codes(F.col("bare"), F.col("codes")), got, target))
    space = lambda p: F.regexp_extract(part, p, 1)
    whole = F.concat(space(r"(?s)^([\s\x{3000}\x{a0}]*)"), F.col("got"), space(r"(?s)([\s\x{3000}\x{a0}]*)$"))
    fixed = F.coalesce(F.col("s.fixed"), C.unmask_codes(part, F.col("codes")))
    rows = rows.select("lang", "original", "e", "pos", F.when(F.col("as_is"), fixed).otherwise(whole).alias("text"))
    joined = rows.groupBy("lang", "original").agg(F.first("e").alias("e"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    done = joined.select("lang", "original", C.reattach(F.array_join("parts.text", ""), F.col("e.lead"), F.col("e.trail")).alias("text"))
    return done.unionByName(split.where(as_it_is).select("lang", "original", F.col("original").alias("text")))


def translate_entries(entries: DataFrame, target: str, engine: Engine, source: str = "auto", memory: DataFrame | None = None, glossary: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """entries with new translations and statuses. Each text is looked up in the memory, else cut at glossary terms, else sent to the engine, once.

    Rows that have nothing to translate from (source auto) are set to skip. The entries are read twice: for their texts, which are
    written with their routes, and for the result. Of a key that the memory has several times the last counts.
    """
    work = E.work_set(entries, overwrite).withColumn("lang", X.resolve_source(F.col("original"), source, target)).where("lang IS NOT NULL")
    lines = stored(work.select("lang", "id", "original"), "lines") if isinstance(engine, Batches) else None
    texts = (work if lines is None else lines).groupBy("lang", "original").agg(F.min("id").alias("first_id"))
    known = memory is not None and not overwrite
    texts = texts.join(E.memory_texts(memory, target), ["original", "lang"], "left") if known else texts.withColumn("text", F.lit(None).cast("string"))
    texts = stored(texts.select("lang", "original", "first_id", "text"), "texts")
    done = [texts.where("text IS NOT NULL").select("lang", "original", "text")]
    rest = texts.where("text IS NULL").drop("text")
    if glossary is not None:
        routed = stored(matched_terms(rest, glossary.where((F.col("tgt") == target) & (F.col("tr") != ""))), "routed")
        done.append(by_segments(routed, engine, target))
        rest = rest.join(routed.select("lang", "original"), ["lang", "original"], "left_anti")
    new = with_engine(rest, engine, target, lines)
    for d in done:
        new = new.unionByName(d)
    # The language of a text follows from it, so the text alone joins.
    out = entries.join(new.select("original", "text"), "original", "left")
    mine = F.lit(True) if overwrite else X.is_blank(F.col("translation")) & (F.col("status") != "skip")
    hit = mine & F.col("text").isNotNull()
    idle = mine & F.col("text").isNull() & ~F.col("status").isin(*KEPT) & F.lit(source == "auto")
    return out.select(
        *[c for c in E.ENTRY if c not in ("translation", "status")],
        F.when(hit, F.col("text")).otherwise(F.col("translation")).alias("translation"),
        F.when(hit, "translated").when(idle, "skip").otherwise(F.col("status")).alias("status"),
    )


def learned_pairs(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """What the translation memory learns from a run: source, src_lang, tgt_lang, target, ord of rows whose translation is new and differs from the original."""
    was = before.select("id", F.col("translation").alias("was"))
    new = after.join(was, "id").where((F.col("status") == "translated") & (F.col("translation") != F.col("was")) & (F.col("translation") != F.col("original")) & ~X.is_blank(F.col("translation")))
    return new.select(F.col("original").alias("source"), X.detect_lang(F.col("original")).alias("src_lang"), F.lit(target).alias("tgt_lang"), F.col("translation").alias("target"), F.col("id").alias("ord"))


def corrections(entries: DataFrame, engine: Callable[[Column, Column], Column]) -> DataFrame:
    """id, old_text, new_text: what a corrector (original, draft -> better) would change; entries stay as they are until a change is accepted (update_by_id)."""
    rows = entries.where(~X.is_blank(F.col("translation")) & F.col("status").isin("translated", "manual"))
    out = rows.select("id", F.col("translation").alias("old_text"), X.stripped(engine(F.col("original"), F.col("translation"))).alias("new_text"))
    return out.where((F.col("new_text") != "") & (F.col("new_text") != F.col("old_text")))


def good_terms(found: DataFrame, source: str) -> DataFrame:
    """Of proposed terms (term, trans) those worth a place in the glossary."""
    t = F.col("term")
    rule = (t != "") & (F.col("trans") != "") & (F.length(t) <= 40) & (t != F.col("trans")) & ~t.rlike(X.TOKEN) & ~(t.contains("[") & t.contains("]"))
    return found.where(rule & t.rlike(WIDE_TERM) if source in WIDE_SOURCES else rule)


def normal_terms(raw: DataFrame) -> DataFrame:
    """src, tgt, term, tr, grp, ord from rows (pair `src->tgt`, term, value, ord), whose value is a text or a JSON object of tr and group."""
    kind = F.from_json("value", "tr string, `group` string")
    listed = F.col("value").rlike(r"^\s*\{")
    pair = F.split("pair", "->")
    return raw.where(F.col("term") != "").select(pair[0].alias("src"), pair[1].alias("tgt"), "term", F.when(listed, F.coalesce(kind["tr"], F.lit(""))).otherwise(F.col("value")).alias("tr"), F.when(listed, F.coalesce(kind["group"], F.lit(""))).otherwise("").alias("grp"), "ord")


def term_groups(terms: DataFrame) -> DataFrame:
    """The groups of terms and their first place."""
    return terms.where(F.col("grp") != "").groupBy("grp").agg(F.min("ord").alias("first"))


def set_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """new (src, tgt, term, tr, ord) in place of the terms of its pairs; a term that was there keeps its group."""
    old = terms.select("src", "tgt", "term", F.col("grp").alias("grp"))
    mine = E.last_of(new.where(F.col("term") != ""), ["src", "tgt", "term"], "ord").join(old, ["src", "tgt", "term"], "left")
    mine = mine.select("src", "tgt", "term", "tr", F.coalesce("grp", F.lit("")).alias("grp"), "ord")
    others = terms.join(new.select("src", "tgt").distinct(), ["src", "tgt"], "left_anti")
    return others.select("src", "tgt", "term", "tr", "grp", "ord").unionByName(mine)


def term_search(terms: DataFrame, group: str = "", query: str = "") -> DataFrame:
    """Terms of a group (empty: all) that hold the query in term, translation or group."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("term"), q) | F.contains(F.lower("tr"), q) | F.contains(F.lower("grp"), q)
    return terms.where((F.col("grp") == group if group else F.lit(True)) & hit)
