"""What a language model answered: lists of translations and proposed terms, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import once


def _array_in(content: Column) -> Column:
    """From the first bracket to the last one."""
    return F.regexp_extract(content, r"(?s)\[.*\]", 0)


def _lines(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _numbered(lines: Column, n: Column) -> Column:
    """The texts t of lines `{"i": N, "t": "..."}` in order of i, the last of equal ones; null unless each of 0 to n - 1 is there and no other."""
    objects = F.transform(lines, lambda x: F.try_parse_json(F.regexp_replace(x, "^,+|,+$", "")))

    def one(v: Column) -> Column:
        i, t = F.try_variant_get(v, "$.i", "variant"), F.try_variant_get(v, "$.t", "variant")
        good = (F.schema_of_variant(i) == "BIGINT") & (F.schema_of_variant(t) == "STRING")
        return F.when(good, F.struct(F.try_variant_get(v, "$.i", "int").alias("i"), F.try_variant_get(v, "$.t", "string").alias("t")))

    def ordered(own: Column) -> Column:
        numbers = F.array_sort(F.array_distinct(F.transform(own, lambda x: x["i"])))
        pairs = F.map_from_entries(F.transform(numbers, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(own, lambda x: x["i"] == k), -1)["t"].alias("value"))))
        return F.when(numbers == F.sequence(F.lit(0), n - 1), F.transform(numbers, lambda k: pairs[k]))

    return once(F.filter(F.transform(objects, one), lambda x: x.isNotNull()), ordered)


def translations_of(content: Column, n: Column) -> Column:
    """n texts, or null: a JSON list of n values within the answer; else lines of numbered objects; else n lines that are each a JSON value."""
    listed = F.from_json(_array_in(content), "array<string>")
    values = lambda lines: F.transform(lines, lambda x: _text(F.try_parse_json(x)))
    by_line = lambda lines: F.when((F.size(lines) == n) & F.forall(values(lines), lambda x: x.isNotNull()), values(lines))
    from_lines = once(_lines(content), lambda lines: F.coalesce(_numbered(lines, n), by_line(lines)))
    return F.when((F.size(listed) == n) & F.forall(listed, lambda x: x.isNotNull()), listed).otherwise(F.when(n > 0, from_lines))


def terms_of(content: Column) -> Column:
    """array(struct(term, trans)) that an answer proposes: a JSON list of objects, else lines of objects; objects without a term are left out."""
    kind = "struct<term:string,trans:string>"
    good = lambda a: F.filter(F.transform(a, lambda x: F.struct(x["term"].alias("term"), F.coalesce(x["trans"], F.lit("")).alias("trans"))), lambda x: F.coalesce(x["term"], F.lit("")) != "")
    listed = F.coalesce(good(F.from_json(_array_in(content), f"array<{kind}>")), F.array().cast(f"array<{kind}>"))
    lines = good(F.transform(_lines(content), lambda x: F.from_json(F.regexp_replace(x, "^,+|,+$", ""), "term string, trans string")))
    return once(listed, lambda a: F.when(F.size(a) > 0, a).otherwise(F.coalesce(lines, F.array().cast(f"array<{kind}>"))))
