"""Text columns: cleaning, keys, quotes, numbers out of text. Everything but NFKC stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The entities that catalogue pages use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&copy;": "©", "&middot;": "·", "&yen;": "¥", "&amp;": "&"}
JA_SPACE = r"[ \t\x{3000}]"


def strip_comments(c: Column) -> Column:
    """HTML without comments."""
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def unescape(c: Column) -> Column:
    """The known entities and all numeric ones replaced, the ampersand last. Numbers beyond Unicode stay as they are."""
    decimal = F.transform(F.regexp_extract_all(c, F.lit(r"&#([0-9]{1,7});"), F.lit(1)), lambda d: F.struct(F.concat(F.lit("&#"), d, F.lit(";")).alias("e"), d.cast("int").alias("n")))
    hexa = F.transform(F.regexp_extract_all(c, F.lit(r"&#[xX]([0-9A-Fa-f]{1,6});"), F.lit(1)), lambda d: F.struct(F.concat(F.lit("&#x"), d, F.lit(";")).alias("e"), F.conv(d, 16, 10).cast("int").alias("n")))
    found = F.filter(F.array_distinct(F.concat(decimal, hexa)), lambda x: (x["n"] > 0) & (x["n"] < 0x110000) & ~x["n"].between(0xD800, 0xDFFF))
    sign = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    plain = F.aggregate(found, F.replace(c, F.lit("&#X"), F.lit("&#x")), lambda acc, x: F.replace(acc, x["e"], sign(x["n"])))
    c = F.when(F.contains(c, F.lit("&#")), plain).otherwise(c)
    for entity, sign_ in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(sign_))
    return c


def clean_text(c: Column) -> Column:
    """Plain text of an HTML fragment: br becomes a line break, tags go, entities are replaced, runs of blanks
    become one space, lines are trimmed. Null stays null."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = unescape(F.regexp_replace(c, r"<[^>]*>", ""))
    c = F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), rf"{JA_SPACE}+", " ")
    return F.regexp_replace(F.regexp_replace(c, r" ?\n ?", "\n"), r"^\s+|\s+$", "")


def escape_html(c: Column) -> Column:
    """Text made safe for HTML, quotes included."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


# What a description's first sentence leaves out: marks in front of the text, and lines that are remarks.
LEADING_MARKS = r"^(?:【[^】]*】\s*)+"
REMARK_LINE = r"^(?:※|【[^】]*】)"


def first_sentence(c: Column, stop: str = "。", limit: int = 100) -> Column:
    """A short description: leading marks and remark lines go; of the first line left the first sentence, with
    its stop; at most ``limit`` signs, the last then an ellipsis. Null where nothing is left."""
    sentence = _sentence(c, stop)
    return F.when(F.length(sentence) > limit, F.concat(F.rtrim(F.substring(sentence, 1, limit - 1)), F.lit("…"))).otherwise(sentence)


def _sentence(c: Column, stop: str) -> Column:
    told = F.filter(F.transform(F.split(F.regexp_replace(c, LEADING_MARKS, ""), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(REMARK_LINE))
    line = F.get(told, F.lit(0))
    return F.when(F.contains(line, F.lit(stop)), F.concat(F.substring_index(line, stop, 1), F.lit(stop))).otherwise(line)


def short_description(c: Column, stop: str = "。", limit: int = 100) -> Column:
    """(text, full_length): :func:`first_sentence` and how long it is without the limit."""
    return F.struct(first_sentence(c, stop, limit).alias("text"), F.length(_sentence(c, stop)).alias("full_length"))


def quotes(c: Column) -> Column:
    """The texts in 「」 and 『』, in order."""
    return F.regexp_extract_all(c, F.lit("[「『](.*?)[」』]"), F.lit(1))


def launch_quotes(c: Column, words: str, within: int = 12) -> Column:
    """The quoted texts that one of ``words`` (a regular expression) follows within ``within`` signs."""
    return F.regexp_extract_all(c, F.lit(f"[「『]([^」』]*)[」』](?=.{{0,{within}}}(?:{words}))"), F.lit(1))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


# The signs that the keys of titles and of review names leave out.
TITLE_SIGNS = r"[\s「」『』\"“”'’・＜＞<>()（）【】]+"
REVIEW_SIGNS = r"[\s　・:：/／,、。.!！?？\-—―~〜()（）\[\]【】「」『』\"'’”×%!®™©]+"


def match_key(c: Column) -> Column:
    """Key for titles: compatibility form, without blanks, quotes and brackets, lower case."""
    return F.lower(F.regexp_replace(nfkc(c), "(?U)" + TITLE_SIGNS, ""))


def review_key(c: Column) -> Column:
    """Key for review names: compatibility form, also without dashes, stops and other signs, lower case."""
    return F.lower(F.regexp_replace(nfkc(c), "(?U)" + REVIEW_SIGNS, ""))


def table_key(c: Column) -> Column:
    """Key for printed tables: compatibility form, no blanks, one wave dash."""
    return F.translate(F.regexp_replace(nfkc(c), r"(?U)\s+", ""), "〜∼", "~~")


def space_free(c: Column) -> Column:
    """Key for same-name groups: only blanks go."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def name_variants(c: Column, prefixes: Sequence[str], least: int = 4) -> Column:
    """The name and what is left without a brand prefix, if at least ``least`` signs."""
    cut = c
    for p in prefixes:
        cut = F.when(cut.startswith(p), F.substring(cut, F.lit(len(p) + 1), F.length(cut))).otherwise(cut)
    return F.array_distinct(F.filter(F.array(c, cut), lambda x: F.length(x) >= least))


def to_number(c: Column) -> Column:
    """The number a text begins with: widths folded, thousands commas dropped; null for a dash or no number."""
    from menuflow.functions.plain import half_width

    plain = F.regexp_replace(half_width(c), r"[,\s]", "")
    return F.nullif(F.regexp_extract(F.translate(plain, "−－", "--"), r"^([+-]?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def split_unit(c: Column) -> Column:
    """(number, unit) of texts such as ``1,234 kcal``."""
    from menuflow.functions.plain import half_width

    return F.struct(to_number(c).alias("number"), F.nullif(F.regexp_extract(half_width(c), r"^[\s+-]*[0-9][0-9,]*(?:\.[0-9]+)?\s*(\S+)", 1), F.lit("")).alias("unit"))


def format_number(c: Column) -> Column:
    """A number in at most six significant digits, without trailing zeros; with an exponent below 1e-4 and from 1e6 on; halves
    of the last digit (of the shortest decimal form) are rounded up. Null stays null."""
    d = c.cast("double")
    written = F.format_string("%.5e", d)
    exponent = F.regexp_extract(written, r"e([+-][0-9]+)$", 1).cast("int")
    bare = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    out = F.concat(bare(F.regexp_extract(written, r"^(.*)e", 1)), F.lit("e"), F.regexp_extract(written, r"e(.*)$", 1))
    for e in range(-4, 6):
        out = F.when(exponent == e, bare(F.format_string(f"%.{5 - e}f", d))).otherwise(out)
    return F.when(d.isNull(), None).when(d == 0, F.lit("0")).when(F.isnan(d), F.lit("nan")).when(F.abs(d) == float("inf"), F.when(d > 0, "inf").otherwise("-inf")).otherwise(out)


def first_rule(c: Column, rules: Sequence[tuple[str, str | None]], otherwise: str | None = None) -> Column:
    """The value of the first rule whose pattern is found; a rule's None is a result of its own."""
    out = None
    for pattern, value in rules:
        out = F.when(c.rlike(pattern), F.lit(value)) if out is None else out.when(c.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def longest_word(c: Column, words: Mapping[str, str], exclude: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The label of the longest word found in ``c``; ties go to the earlier word; a label whose excluded word is found is out."""
    options = []
    for i, (word, label) in enumerate(words.items()):
        veto = F.lit(False)
        for x in (exclude or {}).get(label, ()):
            veto |= F.contains(c, F.lit(x))
        options.append(F.when(F.contains(c, F.lit(word)) & ~veto, F.struct(F.lit(len(word)).alias("n"), F.lit(-i).alias("o"), F.lit(label).alias("label"))))
    return F.array_max(F.filter(F.array(*options), lambda x: x.isNotNull()))["label"]


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the longest common beginning, in one pass over the signs."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    n = F.least(F.length(a), F.length(b))
    first = F.array_position(F.transform(pairs, lambda same: F.coalesce(same, F.lit(False))), False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(F.least(n, (first - 1).cast("int")))


def runs(c: Column, n: int) -> Column:
    """Every run of ``n`` signs of a text, each once, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def url_parts(c: Column) -> Column:
    """(scheme, host, path, query) of an absolute address; the host in lower case without www. or m.; fields empty where absent."""
    part = lambda i: F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    return F.struct(F.lower(part(1)).alias("scheme"), F.regexp_replace(F.lower(part(2)), r"^(?:www|m)\.", "").alias("host"), part(3).alias("path"), part(4).alias("query"))


def slug(c: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^0-9a-z]+", "-"), r"^-+|-+$", "")


def base_key(c: Column) -> Column:
    """A product key without its date suffix ``_yymmdd``."""
    return F.regexp_replace(c, r"_[0-9]{6}$", "")


def label_map(labels: Column, values: Column, keys: Mapping[str, str]) -> Column:
    """A map with known labels renamed by ``keys``; labels it lacks keep their name; of labels with one name the last value stands, null labels are left out."""
    names = F.create_map(*(F.lit(x) for kv in keys.items() for x in kv))
    renamed = F.transform(labels, lambda x: F.coalesce(F.try_element_at(names, x), x))
    pairs = F.filter(F.transform(F.arrays_zip(renamed.alias("k"), values.alias("v")), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))), lambda p: p["k"].isNotNull())
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])))


def classify_name(c: Column, rules: Sequence[tuple[str, str | None]], *, drop: str | None = None, overrides: Mapping[str, str] | None = None, table: Mapping[str, str] | None = None, group: Column | None = None, fallback: str | None = None) -> Column:
    """A class for a name: a pattern of ``overrides`` first, then the class of the ``group`` in ``table`` (an empty one says none),
    then the first of ``rules`` that is found in the name without the parts that ``drop`` finds, then ``fallback``."""
    bare = F.regexp_replace(c, drop, "") if drop else c
    by_group = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), group) if table else F.lit(None).cast("string")
    out = F.when(by_group.isNotNull(), F.nullif(by_group, F.lit("")))
    for pattern, value in rules:
        out = out.when(bare.rlike(pattern), F.lit(value))
    found = out.otherwise(F.lit(fallback))
    for pattern, value in reversed((overrides or {}).items()):
        found = F.when(c.rlike(pattern), F.lit(value)).otherwise(found)
    return found


def strip_tags(c: Column, tags: Sequence[str]) -> Column:
    """(name, tags): the name without 【...】 of the known ``tags``, and which of them it had; others stay."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("【(" + "|".join(tags) + ")】"), F.lit(1)))
    return F.struct(F.trim(F.regexp_replace(c, "【(?:" + "|".join(tags) + ")】", "")).alias("name"), found.alias("tags"))


def number_and_note(c: Column) -> Column:
    """(number, note) of a cell such as ``780円（税込）``: the number it begins with and what stands in brackets behind it."""
    return F.struct(to_number(c).alias("number"), F.nullif(F.regexp_extract(c, r"[（(]([^）)]*)[）)]", 1), F.lit("")).alias("note"))


def listed_parts(c: Column, signs: str = "[、,，]") -> Column:
    """The trimmed, non-empty parts of a list written in one cell, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(c, signs), lambda x: F.regexp_replace(x, r"^[\s\x{3000}]+|[\s\x{3000}]+$", "")), lambda x: x != ""))


def resolve_path(c: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts; a leading slash stays, and a trailing one."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((part == "") | (part == "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step)
    tail = F.when(c.rlike(r"(?:/|/\.{1,2})$") & (F.size(parts) > 0), "/").otherwise("")
    return F.concat(F.when(c.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"), tail)
