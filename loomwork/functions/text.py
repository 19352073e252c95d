"""Column functions on texts: stripping, scripts, pre-filters, immediate checks of a transformed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, scripts, tokens, prefixes.
SPACE = r"[\t-\r\x1c-\x20\u0085   -     　]"
KANA = r"[ぁ-ゖァ-ヺヽヾ]"
CJK = r"[一-鿿]"
HANGUL = r"[가-힯ᄀ-ᇿ㄰-㆏]"
LATIN = "[A-Za-z]"
MEANINGFUL = r"[A-Za-z぀-ヿ一-鿿]"
TOKEN = r"【([0-9]+)】"
BAD_PREFIXES = ["译文：", "译文:", "翻译：", "翻译:", "中文：", "中文:", "Answer:", "Translation:", "输出："]


#: White space as single characters: what Unicode counts as such up to the ideographic space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def translatable(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def uid(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts, joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def mostly_latin(text: Column) -> Column:
    n = count(F.coalesce(text, F.lit("")), LATIN)
    return (n >= 4) & (n / F.greatest(F.length(text), F.lit(1)) > 0.5)


def already_in_target(text: Column, script: str) -> Column:
    """Whether a text needs nothing done, its target having this script; texts of one character never do."""
    s = strip(text)
    rules = {
        "hanzi": s.rlike(CJK) & ~s.rlike(KANA),
        "kana": s.rlike(KANA),
        "hangul": s.rlike(HANGUL),
        "latin": s.rlike(LATIN) & ~s.rlike(KANA) & ~s.rlike(CJK),
    }
    return (F.length(s) <= 1) | rules.get(script, F.lit(False))


def should_skip(text: Column, script: str) -> Column:
    return already_in_target(text, script) | ~strip(text).rlike(MEANINGFUL)


def tokens(text: Column) -> Column:
    """The numbers of all placeholders, sorted: equal arrays are equal multisets."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)))


def kana_share(text: Column) -> Column:
    return count(text, KANA) / F.greatest(F.length(text), F.lit(1))


def has_bad_prefix(text: Column) -> Column:
    out = F.lit(False)
    for p in BAD_PREFIXES:
        out = out | text.startswith(p)
    return out


def check_immediate(original: Column, target: Column, kana_target: bool = False) -> Column:
    """The code of the first rule that a target breaks, null if it breaks none."""
    src, dst = strip(original), strip(target)
    rules = F.when(dst == "", "empty").when((src != "") & (F.length(dst) > F.greatest(6 * F.length(src), F.lit(120))), "too_long")
    rules = rules.when((F.size(tokens(src)) > 0) & (tokens(src) != tokens(dst)), "placeholder")
    if not kana_target:
        rules = rules.when(src.rlike(KANA) & (kana_share(dst) > 0.5), "untranslated")
    return rules.when(has_bad_prefix(dst), "prefix_residue")
