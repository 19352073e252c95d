"""Column functions on what a model returns and on names: cleaning, leaks, tolerant JSON, speakers, scripts, fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions import text as T

# Prefixes, marks of leaked prompts, languages and their scripts, words of text fields.
PREFIXES = ["译文：", "译文:", "翻译：", "翻译:", "中文：", "中文:"]
QUOTES = "\"'“”"
LEAKS = ["```", "JSON", "json 对象", "markdown", "占位符", "不要输出", "不需要任何解释", "译文不含换行符", "译文中没有", "无换行符", "保持原样输出", "键与输入", "翻译结果", "输出结果如下", "最终输出如下", "以下是翻译", "好的，我将", "好的，已", "按照您的要求", "按您的要求", "已按要求"]
SCRIPTS = {
    "简体中文": "hanzi", "中文": "hanzi", "简体": "hanzi", "chinese": "hanzi", "simplified": "hanzi", "zh": "hanzi",
    "繁体": "hanzi", "繁體": "hanzi", "traditional": "hanzi", "zh-tw": "hanzi", "zh-hant": "hanzi",
    "日本語": "kana", "日语": "kana", "日文": "kana", "japanese": "kana", "ja": "kana",
    "한국어": "hangul", "韩语": "hangul", "韓語": "hangul", "韩文": "hangul", "korean": "hangul", "ko": "hangul",
    "english": "latin", "英语": "latin", "英文": "latin", "en": "latin", "français": "latin", "francais": "latin", "french": "latin",
    "deutsch": "latin", "german": "latin", "español": "latin", "espanol": "latin", "spanish": "latin",
}
FIELD_WORDS = ["text", "subtitle", "caption", "tooltip", "dialogue"]


def clean(output: Column) -> Column:
    """Without fences, leading labels and one pair of quotes; line ends are \\n. A chain of replacements, each of which names its input once."""
    s = F.regexp_replace(T.strip(output), r"(?s)^`{3,}+(?:(?:json|text)[^\n]*\n)?(.*?)`*\z", "$1")
    s = F.regexp_replace(s, "^" + "".join(f"(?:{p}{T.SPACE}*)?" for p in PREFIXES), "")
    s = F.regexp_replace(s, rf"(?s)^([{QUOTES}])(.*)\1\z", "$2")
    return T.strip(F.regexp_replace(s, "\r\n?", "\n"))


def leaked(value: Column, original: Column) -> Column:
    """Whether a value holds a prompt's words, or is far longer than its original."""
    s, n = T.strip(value), F.length(F.coalesce(original, F.lit("")))
    marked = s.rlike("(?iu)" + "|".join(re.escape(m) for m in LEAKS))
    return (s != "") & (marked | ((n >= 8) & (F.length(s) > F.greatest(F.lit(64), 6 * n))))


def parsed_map(output: Column) -> Column:
    """A map of strings from an output that is a JSON object or holds one; null if there is none."""
    whole = F.when(T.strip(output).startswith("{"), F.from_json(output, "map<string,string>"))
    return F.coalesce(whole, F.from_json(F.nullif(F.regexp_extract(output, r"(?s)\{.*\}", 0), F.lit("")), "map<string,string>"))


def speaker(text: Column) -> Column:
    """The name in front of the first colon of a line, "" if there is none or it is escaped."""
    name = F.trim(F.regexp_extract(text, r"^([A-Za-z](?U:[\w '\-.]){0,40}?)(?<!\\):[ \t]*(.*)$", 1))
    return F.when(F.split(text, " ")[0].contains("\\:"), "").otherwise(F.coalesce(name, F.lit("")))


def target_script(language: Column) -> Column:
    """The script of a language's name: that of the first known name that holds it or is held; hanzi for none, unknown for others."""
    low = F.lower(T.strip(language))
    known = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in SCRIPTS.items()]), lambda x: F.contains(low, x["k"]) | F.contains(x["k"], low))
    return F.when(low == "", "hanzi").otherwise(F.coalesce(F.get(known, F.lit(0))["v"], F.lit("unknown")))


def field_is_text(name: Column) -> Column:
    """Whether one of the words of a field's name, apart by capitals, says that people read it."""
    words = F.transform(F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"), F.lit(0)), F.lower)
    return F.arrays_overlap(words, F.array(*map(F.lit, FIELD_WORDS)))


def table_text_ok(value: Column) -> Column:
    """Whether a value of a language table is to be read: at most 1000 characters, a letter, no address, not one placeholder."""
    s = T.strip(value)
    return F.length(s).between(1, 1000) & s.rlike(r"\p{L}") & ~s.contains("://") & ~(s.startswith("{") & s.endswith("}"))
