"""Translation with a model of one's own: texts cut into sentences and chunks, each different piece asked for once, and put together again by place.

What needs no model has a quick path. The rest is normalised, glossary terms become placeholders, placeholders stay where they
are, and what is between is cut into sentences and those into chunks of bounded size. A piece whose translation looks made up is
left as it is.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from lexloom.functions import text as X
from lexloom.functions.shared import stored
from lexloom.operators.translate import Engine, asked

#: Latin letters and their Cyrillic ones; abbreviations that end no sentence; marks that close a quotation; placeholders.
LATIN, CYRILLIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "АВСДЕФГХИЙКЛМНОПКРСТУВВХЫЗавсдефгхийклмнопкрстуввхыз"
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "etc", "e.g", "i.e", "vs", "inc", "ltd", "co", "fig", "al")
CLOSING = "\"'»”’)\\]}"
PLACEHOLDER = r"\\[A-Za-z]\s*\[[^\[\]]*\]|<[^<>]{1,60}>|\{[^{}]{0,60}\}"
_LATIN_TERM = re.compile(r"[A-Za-z0-9 _'.-]+")
#: Where a sentence ends: in Japanese after a mark, elsewhere after one that white space follows and that ends no abbreviation.
JA_END = r"(?<=[。！？!?…\n])"
_SHORT = "|".join(re.escape(a) for a in ABBREVIATIONS)
END = rf"(?U)(?:(?<=[.!?…])(?=\s|\z)|(?<=[.!?…][{CLOSING}])(?=\s|\z)|(?<=\n))(?<!(?i:(?:^|\s)(?:{_SHORT})\.\s{{0,20}}))"


def transliterated(text: Column, target: str) -> Column:
    """A hot key or a code of up to three Latin letters in Cyrillic, for Russian; null for words and all else."""
    if target != "ru":
        return F.lit(None).cast("string")
    code = (F.length(text) == 1) | ~text.rlike("(?i)[aeiouy]") | text.rlike(r"^(.)\1*\z")
    return F.when(text.rlike(r"^[A-Za-z]{1,3}\z") & code, F.translate(text, LATIN, CYRILLIC))


def is_single_mark(text: Column) -> Column:
    """One character that needs no translation: a Latin letter, a digit, a mark, a symbol or a space."""
    return text.rlike(r"^(?s:[A-Za-z\p{P}\p{S}\p{N}\p{Z}])\z") | X.is_single_letter(text)


def normalised(text: Column) -> Column:
    """Compatibility forms (which no built-in expression knows), no zero-width and control characters, runs of blanks as one."""

    def forms(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    out = F.pandas_udf(forms, PT.StringType())(text)
    return F.regexp_replace(F.regexp_replace(out, r"[\x{200b}\x{feff}\x00-\x08\x0e-\x1f]", ""), r"[ \t\f\x0b]+", " ")


def sentences(text: Column, source: str) -> Column:
    """The sentences of a text; joined they give it back."""
    return F.filter(X.split_by(text, JA_END if source == "ja" else END), lambda s: s != "")


def chunks(text: Column, most: int) -> Column:
    """Pieces of up to most words; joined they give the text back. A cut is made after the last mark in the second half, if there is one."""
    word, mark = re.compile(r"\s*\S+|\s+"), re.compile(r"[.,!?;:…、。！？]\Z")

    def cut(t: str) -> list[str]:
        words, out = word.findall(t), []
        while len(words) > most:
            at = next((k for k in range(most, most // 2, -1) if mark.search(words[k - 1])), most)
            out.append("".join(words[:at]))
            words = words[at:]
        return [*out, "".join(words)]

    def run(s: pd.Series) -> pd.Series:
        return s.map(cut, na_action="ignore")

    return F.pandas_udf(run, PT.ArrayType(PT.StringType()))(text)


def term_pattern(term: str) -> re.Pattern | None:
    """Where a term stands: a Latin one as whole words in any case, one of letters and digits anywhere; others nowhere."""
    if _LATIN_TERM.fullmatch(term):
        return re.compile(rf"(?<!\w){re.escape(term)}(?!\w)", re.I)
    return re.compile(re.escape(term)) if term.isalnum() else None


def with_terms(text: Column, glossary: dict[str, str]) -> Column:
    """Terms as placeholders `{gN}`, the longest first; N is the term's place by length."""
    longest = sorted(glossary.items(), key=lambda kv: -len(kv[0]))
    patterns = [(n, p) for n, (term, value) in enumerate(longest) if term and term != value and (p := term_pattern(term))]

    def inject(t: str) -> str:
        for n, p in patterns:
            t = p.sub(f"{{g{n}}}", t)
        return t

    def run(s: pd.Series) -> pd.Series:
        return s.map(inject, na_action="ignore")

    return F.pandas_udf(run, PT.StringType())(text) if patterns else text


def without_terms(text: Column, glossary: dict[str, str]) -> Column:
    """The placeholders as the terms' translations, in one pass."""
    values = [value for _, value in sorted(glossary.items(), key=lambda kv: -len(kv[0]))]
    if not values:
        return text
    found, parts = F.regexp_extract_all(text, F.lit(r"\{g(\d+)\}"), F.lit(1)), F.split(text, r"\{g\d+\}", -1)
    own = F.transform(found, lambda n: F.coalesce(F.get(F.array(*map(F.lit, values)), n.cast("int")), F.concat(F.lit("{g"), n, F.lit("}"))))
    return F.array_join(F.zip_with(parts, own, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def trimmed(text: Column, source: Column) -> Column:
    """Marks that a model sets after texts of up to four characters, taken off."""
    bare = F.regexp_replace(text, r"\s*[.,!?;:]+\z", "")
    alone = bare.endswith(")") & (F.regexp_count(bare, F.lit(r"\(")) < F.regexp_count(bare, F.lit(r"\)")))
    bare = F.when(alone, F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - 1))).otherwise(bare)
    short = (F.length(X.stripped(source)) <= 4) & (X.stripped(source) != "") & ~X.stripped(source).rlike(r"[.,!?;:]+\z")
    return F.when(short, F.regexp_replace(bare, r"\s+([,.!?;:])", "$1")).otherwise(text)


def offline_translations(texts: DataFrame, engine: Engine, source: str, target: str, glossary: dict[str, str] | None = None, most: int = 478, key: str = "id", text: str = "original") -> DataFrame:
    """key, text: the translation of each text. Keys are unique; a null text stays null. glossary: terms of one language, as many as fit a task."""
    glossary = glossary or {}
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("t"))
    quick = F.coalesce(transliterated(F.col("t"), target), F.when(is_single_mark(F.col("t")) | (F.col("t") == ""), F.col("t")))
    rows = rows.withColumn("quick", quick)
    work = rows.where("quick IS NULL AND t IS NOT NULL").select("key", with_terms(normalised(F.col("t")), glossary).alias("n"))
    # Placeholders stand between the parts.
    marks, parts = F.regexp_extract_all("n", F.lit(PLACEHOLDER), F.lit(0)), X.split_by(F.col("n"), PLACEHOLDER)
    pairs = F.flatten(F.zip_with(parts, marks, lambda p, m: F.concat(F.transform(sentences(F.coalesce(p, F.lit("")), source), lambda s: F.struct(s.alias("s"), X.has_letter(s).alias("live"))), F.array(F.struct(m.alias("s"), F.lit(False).alias("live"))))))
    cut = work.select("key", F.posexplode(F.filter(pairs, lambda x: x["s"].isNotNull())).alias("at", "x")).select("key", "at", "x.live", "x.s")
    # Read three times: what is to be asked, what was answered, and what stays.
    cut = stored(cut, "sentences")
    pieces = stored(cut.where("live").select("key", "at", F.posexplode(chunks(F.col("s"), most)).alias("sub", "piece")), "pieces")
    wanted = pieces.groupBy("piece").agg(F.min(F.xxhash64("key", "at", "sub")).alias("first_id")).withColumn("lang", F.lit(source))
    out = asked(wanted, engine, "piece").select("piece", "out")
    # What looks made up, or wasn't answered, stays as it is.
    good = F.col("out").isNotNull() & ~X.suspicious(F.col("out"), target, F.lit(0.0))
    spoken = pieces.join(out, "piece").select("key", "at", "sub", F.when(good, F.col("out")).otherwise(F.col("piece")).alias("s"))
    both = spoken.unionByName(cut.where("NOT live").select("key", "at", F.lit(0).alias("sub"), "s"))
    joined = both.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "sub", "s")))["s"], "").alias("joined"))
    done = rows.join(joined, "key", "left")
    text_ = F.coalesce("quick", without_terms(X.guard_length(F.col("t"), trimmed(F.coalesce("joined", F.when(F.col("t").isNotNull(), "")), F.col("t"))), glossary))
    return done.select(F.col("key").alias(key), text_.alias("text"))
