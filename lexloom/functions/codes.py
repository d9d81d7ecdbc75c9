"""Codes within texts: masking, codes at the edges, and the fixers of translated texts, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.text import once

#: The kinds of codes, in order; what tells code in brackets from text; marks and what they become.
CODE = r"\\\\|\\[A-Za-z]*\[[^\]]*\]|\\[A-Za-z]+|\\[{}<>|.!^_]|\\|%[0-9]+|</?[A-Za-z][^>]{0,30}>|\[\[|\[[^\[\]\n]{1,120}\]"
TEXT_SCRIPT = "[\u3040-\u30ff\u31f0-\u31ff\u4e00-\u9fff\u3400-\u4dbf\uac00-\ud7af\u0400-\u04ff]"
CODE_HINT, IDENTIFIER = r"""[._()$'"+*/%=<>&|!]""", "^[A-Za-z_][A-Za-z0-9_ ]*$"
EDGE_TAG = r"\{[^}\n]{1,120}\}"
WIDE_MARKS, MARKS = "\u3002\uff01\uff1f\uff0c\uff1a\uff1b\u3001\uff5e", ".!?,:;,~"
NO_GAP = " \\t.!?,;:)\\]}>\u00bb\u201c\u201d\"'\u2026"
WORD_GAP = "([\u0410-\u042f\u0430-\u044f\u0401\u0451])([.!?,;:])([\u0410-\u042f\u0430-\u044f\u0401\u0451])"
CIRCLED = "[\u2460-\u2473]"
#: The same kinds, with brackets only if they hold code.
_BRACKETED = rf"\[(?![^\[\]\n]*{TEXT_SCRIPT})(?:(?=[^\[\]\n]*{CODE_HINT})|(?=\s*[A-Za-z_][A-Za-z0-9_ ]*\s*\]))[^\[\]\n]{{1,120}}\]"
#: What a code begins with goes first, so that other places of a text are passed at once.
_CODE = r"(?=[\\%<\[])(?:" + CODE + ")"
_EDGE = r"(?=[\\%<\[{])(?:" + CODE.rpartition("|")[0] + "|" + _BRACKETED + "|" + EDGE_TAG + ")"
_BEGINS, _NO_CODES = r"[\\%<\[]", "array<string>"


def is_code(found: Column) -> Column:
    """Whether what matched CODE is one: brackets must hold an expression or a name, not text."""
    inner = X.stripped(F.substring(found, F.lit(2), F.length(found) - 2))
    listed = found.startswith("[") & (found != "[[")
    return ~listed | ((inner != "") & ~inner.rlike(TEXT_SCRIPT) & (inner.rlike(CODE_HINT) | inner.rlike(IDENTIFIER)))


def _woven(parts: Column, between: Column) -> Column:
    return F.array_join(F.zip_with(parts, between, lambda p, t: F.concat(F.coalesce(p, F.lit("")), F.coalesce(t, F.lit("")))), "")


def mask_codes(text: Column) -> Column:
    """struct(masked, codes): each code replaced by a numbered token."""
    found = F.struct(F.regexp_extract_all(text, F.lit(_CODE), F.lit(0)).alias("all"), X.split_by(text, _CODE).alias("parts"))

    def numbered(z: Column, flags: Column) -> Column:
        own = F.filter(F.sequence(F.lit(0), F.size(flags) - 1), lambda i: F.get(flags, i) == 1)
        token = lambda own, c, i: F.when(F.get(flags, i) == 1, F.concat(F.lit("<x"), (F.array_position(own, i) - 1).cast("string"), F.lit("/>"))).otherwise(c)
        tokens = F.when(F.size(flags) > 0, once(own, lambda own: F.transform(z["all"], lambda c, i: token(own, c, i)))).otherwise(z["all"])
        return F.struct(_woven(z["parts"], tokens).alias("masked"), F.filter(z["all"], lambda c, i: F.get(flags, i) == 1).alias("codes"))

    some = once(found, lambda z: once(F.transform(z["all"], lambda c: is_code(c).cast("int")), lambda flags: numbered(z, flags)))
    return F.when(~text.rlike(_BEGINS), F.struct(text.alias("masked"), F.array().cast(_NO_CODES).alias("codes"))).otherwise(some)


def codes_of(text: Column) -> Column:
    """The codes alone."""
    return F.when(~text.rlike(_BEGINS), F.array().cast(_NO_CODES)).otherwise(F.filter(F.regexp_extract_all(text, F.lit(_CODE), F.lit(0)), is_code))


def unmask_codes(masked: Column, codes: Column) -> Column:
    """Tokens replaced by their codes, in one pass; a token without a code stays."""
    tokens = F.regexp_extract_all(masked, F.lit(X.TOKEN), F.lit(0))
    back = F.zip_with(tokens, X.tokens_of(masked), lambda t, i: F.coalesce(F.get(codes, i.try_cast("int")), t))
    return F.when(~masked.contains("<"), masked).otherwise(_woven(X.split_by(masked, X.TOKEN), back))


def is_code_only(masked: Column) -> Column:
    """Nothing but tokens and punctuation is left."""
    return ~F.regexp_replace(masked, X.TOKEN, "").rlike(r"[\p{L}\p{N}_]")


def split_edges(text: Column) -> Column:
    """struct(lead, middle, trail): the codes and {tags} at the text's begin and end, and what is between."""
    lead = F.regexp_extract(text, f"^((?:{_EDGE})*+)", 1)

    def rest(led: Column) -> Column:
        after = F.substring(text, F.length(led) + 1, F.length(text))
        return once(after, lambda a: once(F.regexp_extract(a, f"((?:{_EDGE})++)$", 1), lambda t: F.struct(
            F.regexp_extract_all(led, F.lit(_EDGE), F.lit(0)).alias("lead"),
            F.substring(a, F.lit(1), F.length(a) - F.length(t)).alias("middle"),
            F.regexp_extract_all(t, F.lit(_EDGE), F.lit(0)).alias("trail"),
        )))

    return once(lead, rest)


def reattach(text: Column, lead: Column, trail: Column) -> Column:
    """text with the edge codes that it lost; what it kept of them isn't doubled."""
    joined = lambda a: F.array_join(a, "")
    fronts = F.transform(F.sequence(F.lit(0), F.size(lead)), lambda j: joined(F.slice(lead, F.lit(1), j)))
    kept = F.element_at(F.filter(fronts, lambda p: text.startswith(p)), -1)
    led = F.concat(joined(lead), F.substring(text, F.length(kept) + 1, F.length(text)))
    backs = lambda t: F.transform(F.sequence(F.lit(1), F.size(trail)), lambda j: joined(F.slice(trail, j, F.size(trail))))

    def closed(t: Column) -> Column:
        own = F.coalesce(F.get(F.filter(backs(t), lambda p: t.endswith(p)), F.lit(0)), F.lit(""))
        return F.when(F.size(trail) > 0, F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(own)), joined(trail))).otherwise(t)

    return once(led, closed)


def fix_codes(source: Column, target: Column) -> Column:
    """Codes that target has more often than source go, the first ones first."""
    times = lambda t, c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.length(c)

    def fewer(parts: Column, c: Column, surplus: Column) -> Column:
        return F.concat(F.array_join(F.slice(parts, F.lit(1), surplus + 1), ""), F.when(F.size(parts) > surplus + 1, F.concat(c, F.call_function("array_join", F.slice(parts, surplus + 2, F.size(parts)), c))).otherwise(F.lit("")))

    def without(t: Column, c: Column) -> Column:
        quoted = F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")
        parts = F.when(t.contains(X.BETWEEN), F.call_function("split", t, quoted, F.lit(-1))).otherwise(F.split(F.replace(t, c, F.lit(X.BETWEEN)), X.BETWEEN, -1))
        return once((times(t, c) - times(source, c)).cast("int"), lambda surplus: F.when(surplus > 0, once(parts, lambda p: fewer(p, c, surplus))).otherwise(t))

    mended = once(codes_of(target), lambda codes: F.when(F.size(codes) == 0, target).otherwise(F.aggregate(F.array_distinct(codes), target, without)))
    return F.when(target == source, target).otherwise(mended)


def _replaced(text: Column, pattern: str, f) -> Column:
    """Matches of pattern replaced by f(array of matches)."""
    return _woven(X.split_by(text, pattern), once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), f))


def fix_circled(source: Column, target: Column) -> Column:
    """The first numbers outside of groups become the source's circled ones, in order."""
    own = F.regexp_extract_all(source, F.lit(CIRCLED), F.lit(0))
    digits = lambda t: t.rlike(r"^\d")
    before = lambda a, i: F.size(F.filter(F.slice(a, F.lit(1), i), digits))
    back = lambda a: F.transform(a, lambda t, i: F.when(digits(t), F.coalesce(F.get(own, before(a, i)), t)).otherwise(t))
    return F.when((F.size(own) == 0) | (target == source), target).otherwise(_replaced(target, X.GROUP + r"|\d+", back))


def fix_signs(source: Column, target: Column) -> Column:
    """Numbers that lost their minus get it back, if both texts have as many numbers."""
    number = r"-?\d+"
    own = F.regexp_extract_all(source, F.lit(number), F.lit(0))
    signed = lambda a: F.zip_with(a, own, lambda t, s: F.when(s.startswith("-") & (F.ltrim(t, F.lit("-")) == F.ltrim(s, F.lit("-"))), s).otherwise(t))
    return F.when(source.rlike(r"-\d") & (F.size(own) == F.regexp_count(target, F.lit(number))), _replaced(target, number, signed)).otherwise(target)


def fix_punctuation(text: Column, target: str) -> Column:
    """Wide marks become those of the target language, with a space before a word; words run together around a mark are parted."""
    if target in ("ja", "zh"):
        return text
    spaced = F.regexp_replace(text, f"([{WIDE_MARKS}])(?=[^{NO_GAP}])", "$1 ")
    # translate looks at each character on its own, and few texts hold one of the marks.
    plain = F.when(text.rlike(f"[{WIDE_MARKS}]"), F.translate(spaced, WIDE_MARKS, MARKS)).otherwise(text)
    return F.regexp_replace(plain, WORD_GAP, "$1$2 $3")


def apply_fixers(source: Column, text: Column, target: str) -> Column:
    """Codes, doubled backslashes, circled numbers, signs, marks, the first letter's case; a text equal to its source stays."""
    steps = [lambda t: fix_codes(source, t), lambda t: X.fix_escape(source, t), lambda t: fix_circled(source, t), lambda t: fix_signs(source, t), lambda t: fix_punctuation(t, target), lambda t: X.fix_leading_case(source, t)]
    fixed = text
    for step in steps:
        fixed = once(fixed, step)
    return F.when(text == source, text).otherwise(fixed)


def glossary_segments(text: Column, terms: Column) -> Column:
    """array(struct(part, fixed)): text cut at the terms (array of struct(term, tr)), the longest first; fixed is null elsewhere."""
    safe = F.transform(F.sort_array(F.transform(terms, lambda t: F.struct((-F.length(t["term"])).alias("n"), t["term"].alias("term")))), lambda t: F.regexp_replace(t["term"], r"([^\p{L}\p{N}\s])", r"\\$1"))

    def cut(pattern: Column) -> Column:
        found, parts = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
        pairs = F.flatten(F.zip_with(parts, found, lambda p, t: F.array(F.struct(p.alias("part"), F.lit(None).cast("string").alias("fixed")), F.struct(t.alias("part"), F.get(F.filter(terms, lambda x: x["term"] == t), F.lit(0))["tr"].alias("fixed")))))
        return F.filter(pairs, lambda p: F.coalesce(p["part"], F.lit("")) != "")

    whole = F.array(F.struct(text.alias("part"), F.lit(None).cast("string").alias("fixed")))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) <= 0, whole).otherwise(once(F.array_join(safe, "|"), cut))
