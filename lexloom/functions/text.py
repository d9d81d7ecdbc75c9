"""Text predicates and scalar functions as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes of scripts, the codes of game texts, the characters of a path.
KANA, HAN, HANGUL, CYRILLIC, LATIN = "[\u3040-\u30ff\u31f0-\u31ff]", "[\u4e00-\u9fff\u3400-\u4dbf]", "[\uac00-\ud7a3]", "[\u0400-\u04ff]", "[A-Za-z]"
WIDE = "[\u3000-\u9fff\uf900-\ufaff\uac00-\ud7af]"
CODES = r"\\[A-Za-z]?\[[^\]]*\]|\\[{}<>|.!^_]?|\\[A-Za-z]+|%[0-9]+"
TOKEN = r"</?x(\d+)\s*/?>"
LETTERS = "[\u3040-\u30ff\u31f0-\u31ff\uff65-\uff9f\u0400-\u04ffA-Za-z]"
PATH = r"^[\w.\\/\-@!#$%^&*()\[\]{}<>:;,?+=~`|']+$"
LOW_SCORE, MANY_REPEATS, LITTLE_FIT = -1.0, 0.25, 0.5
#: A character that texts hardly hold.
BETWEEN = "\x01"
#: White space that stripping removes.
SPACES = r"^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for all places that f uses it in (branches and lambdas would each compute it again)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def split_by(text: Column, pattern: str) -> Column:
    """What split gives for a fixed pattern. split compiles its pattern for every row, but not one of a single character; a text that holds that one takes the plain way."""
    return F.when(text.contains(BETWEEN), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, BETWEEN), BETWEEN, -1))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, "")


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text), F.lit("")) == ""


def detect_lang(text: Column) -> Column:
    """ja, zh, ko, ru or en by the first script found in that order, codes left out; null if none."""
    # Few texts hold a code, so taking codes out again for each test costs less than a function that keeps the result.
    bare = F.when(text.contains("\\") | text.contains("%"), F.regexp_replace(text, CODES, "")).otherwise(text)
    return F.when(bare.rlike(KANA), "ja").when(bare.rlike(HAN), "zh").when(bare.rlike(HANGUL), "ko").when(bare.rlike(CYRILLIC), "ru").when(bare.rlike(LATIN), "en")


def resolve_source(text: Column, declared: str, target: str) -> Column:
    """The language to translate from: what is detected, else what is declared; null if that is the target."""
    found = F.coalesce(detect_lang(text), F.lit(None if declared == "auto" else declared).cast("string"))
    return once(found, lambda lang: F.when(lang != target, lang))


def estimate_tokens(text: Column) -> Column:
    n = F.length(text)
    return F.greatest(F.lit(1), F.when(text.rlike(WIDE), n).otherwise(F.floor(n / 4).cast("int")))


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def is_single_letter(text: Column) -> Column:
    """One letter of kana (half-width too), Cyrillic or Latin."""
    return stripped(text).rlike(f"^{LETTERS}$")


def is_code_token(text: Column) -> Column:
    """A web address, a hex colour, or an ASCII path with an extension; one token."""
    s = stripped(text)
    path = s.rlike(r"[\\/]") & s.rlike(r"\.[A-Za-z0-9]{1,5}$") & s.rlike(PATH)
    return (s != "") & ~s.rlike(r"\s") & (s.rlike("^https?://") | s.rlike("^#[0-9a-fA-F]{3,8}$") | path)


def context_short(context: Column) -> Column:
    """The last two parts of a path of more."""
    parts = F.filter(F.split(F.replace(context, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(context)


def state_of(status: Column) -> Column:
    """skip, done (translated, corrected), draft (manual) or empty."""
    return F.when(status == "skip", "skip").when(status.isin("translated", "corrected"), "done").when(status == "manual", "draft").otherwise("empty")


def next_state(state: Column) -> Column:
    return F.when(state == "empty", "draft").when(state == "draft", "done").otherwise("empty")


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def tokens_valid(masked: Column, codes: Column) -> Column:
    """The token numbers are 0 to the number of codes less 1, each once."""
    found = F.array_sort(F.transform(tokens_of(masked), lambda x: x.cast("int")))
    return F.when(codes == 0, F.size(found) == 0).otherwise(found == F.sequence(F.lit(0), F.greatest(codes, F.lit(1)) - 1))


def guard_tokens(source: Column, target: Column) -> Column:
    """target if it has the same tokens in the same order, else source."""
    return F.when(tokens_of(source) == tokens_of(target), target).otherwise(source)


#: Groups in brackets or braces, four levels deep, by runs that give nothing back (so a long one needs no stack).
GROUP = r"[\[{][^\[\]{}]*+[\]}]"
for _ in range(3):
    GROUP = r"[\[{](?:[^\[\]{}]++|" + GROUP + r")*+[\]}]"
#: A variable of scenario scripts.
SCENARIO_VARIABLE = r"%[A-Za-z_]\w*|&[A-Za-z_][\w.]*|\b(?:f|sf|tf|mp)\.[A-Za-z_]\w*"


def _folded_groups(text: Column) -> Column:
    """The outermost groups by a count of open brackets; one that isn't closed goes to the end."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\[\]{}]*+[\[\]{}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("start"), F.array().cast("array<struct<a:int,n:int>>").alias("out"))

    def step(s: Column, piece: Column) -> Column:
        pos, opens = s["pos"] + F.length(piece), F.right(piece, F.lit(1)).isin("[", "{")
        depth = F.when(opens, s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
        start = F.when(opens & (s["depth"] == 0), pos).otherwise(s["start"])
        done = ~opens & (s["depth"] == 1)
        return F.struct(depth.alias("depth"), pos.alias("pos"), start.alias("start"), F.when(done, F.concat(s["out"], F.array(F.struct(s["start"].alias("a"), (pos - s["start"] + 1).alias("n"))))).otherwise(s["out"]).alias("out"))

    def closed(s: Column) -> Column:
        rest = F.array(F.struct(s["start"].alias("a"), (F.length(text) - s["start"] + 1).alias("n")))
        return F.when(s["depth"] > 0, F.concat(s["out"], rest)).otherwise(s["out"])

    return F.transform(F.aggregate(pieces, zero, step, closed), lambda g: F.substring(text, g["a"], g["n"]))


def outer_groups(text: Column) -> Column:
    """The outermost groups in brackets or braces, of any depth; one that isn't closed goes to the end."""
    plain = F.regexp_extract_all(text, F.lit(GROUP), F.lit(0))
    left = F.regexp_replace(text, GROUP, "")
    return F.when(left.rlike(r"[\[{]"), _folded_groups(text)).otherwise(plain)


def _in_order(found: Column, target: Column) -> Column:
    def step(at: Column, group: Column) -> Column:
        hit = F.call_function("locate", group, target, at)
        return F.when((at > 0) & (hit > 0), hit + F.length(group)).otherwise(F.lit(0))

    return F.aggregate(found, F.lit(1), step) > 0


def groups_in_order(source: Column, target: Column, pattern: str) -> Column:
    """Each match of pattern in source occurs verbatim in target, after the one before."""
    return _in_order(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), target)


def variables_safe(source: Column, target: Column) -> Column:
    """Each outermost group of source stands verbatim in target, in order."""
    return _in_order(outer_groups(source), target)


def scenario_variables_safe(source: Column, target: Column) -> Column:
    """The same of a scenario's variables."""
    return groups_in_order(source, target, SCENARIO_VARIABLE)


def fix_escape(source: Column, target: Column) -> Column:
    """Doubled backslashes that the source lacks become single ones."""
    double, single = F.lit("\\\\"), F.lit("\\")
    return F.when(~source.contains(double), F.replace(target, double, single)).otherwise(target)


def fix_leading_case(source: Column, target: Column) -> Column:
    """The source's first letter, if the target's differs from it in case only."""
    a, b = F.substring(source, 1, 1), F.substring(target, 1, 1)
    other_case = a.rlike(r"^\p{L}") & b.rlike(r"^\p{L}") & (F.lower(a) == F.lower(b)) & (a != b)
    return F.when(other_case, F.concat(a, F.substring(target, F.lit(2), F.length(target)))).otherwise(target)


def guard_length(source: Column, target: Column) -> Column:
    return F.when(F.length(target) > F.greatest(8 * F.length(source), F.lit(20)), source).otherwise(target)


def script_fit(text: Column, target: str) -> Column:
    """The share of letters in the target's script; 1 without letters or for other targets."""
    own = {"ru": "[\u0400-\u04ff]", "ja": "[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]", "en": "[A-Za-z]"}.get(target)
    if own is None:
        return F.lit(1.0)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(own)) / letters).otherwise(1.0)


def repeated_stems(text: Column, size: int = 5) -> Column:
    """The share of words whose first letters another word has too; 0 for under four words. Sorted stems need one pass."""
    words = lambda t: F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    # Lower case moves the bounds of words in no text of ASCII, which is lowered in one go.
    low = F.when(F.octet_length(text) == F.length(text), words(F.lower(text))).otherwise(F.transform(words(text), lambda w: F.lower(w)))
    stems = F.sort_array(F.transform(low, lambda w: F.substring(w, 1, size)))

    def share(s: Column) -> Column:
        again = F.size(F.filter(s, lambda w, i: w.eqNullSafe(F.get(s, i - 1)) | w.eqNullSafe(F.get(s, i + 1))))
        return F.when(F.size(s) < 4, 0.0).otherwise(again / F.size(s))

    return once(stems, share)


def suspicious(text: Column, target: str, score: Column) -> Column:
    """Whether a translation is likely made up: a low mean score, repeated stems, or letters of another script."""
    n = F.length(text)
    return (n > 0) & (((n > 6) & (score < LOW_SCORE)) | ((n > 3) & (repeated_stems(text) > MANY_REPEATS)) | (script_fit(text, target) < LITTLE_FIT))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def short_md5(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def size_text(size: Column, russian: bool = True) -> Column:
    """A number of bytes in megabytes with one digit, or from a gigabyte on in gigabytes with two."""
    mega, giga = ("МБ", "ГБ") if russian else ("MB", "GB")
    return F.when(size >= 1 << 30, F.format_string(f"%.2f {giga}", size / (1 << 30))).otherwise(F.format_string(f"%.1f {mega}", size / (1 << 20)))


def spaced_number(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def escape_literal(text: Column) -> Column:
    """text as it stands between double quotes of a script: one line, backslashes and quotes escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(F.regexp_replace(out, r"\r\n|\r|\n", r"\\n"), F.lit("\t"), F.lit("\\t"))


def unescape_literal(text: Column) -> Column:
    """The text of such a literal. Doubled backslashes are set apart first, so what follows one isn't taken for an escape."""
    plain = lambda x: F.regexp_replace(F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), r"(?s)\\(.)", "$1")
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def escape_html(text: Column) -> Column:
    """Quotes stay."""
    out = text
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out
