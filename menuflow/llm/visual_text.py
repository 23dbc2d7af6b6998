"""One form for text that looks the same, by a compiled longest-match transducer over grapheme clusters.

:func:`compile_transducer` builds one automaton out of rules - width forms, compatibility ideographs and
radicals, look-alike letters, wave dashes, and every way of composing a sign from its parts. Its keys are
strings of one or more signs: ``ｶﾞ`` and ``カ`` with a combining mark are keys of their own beside ``ｶ``, and a
Cyrillic letter with an accent is a key whose output is the accented Latin letter. It is checked when it is built: no key has two outputs, only lone marks
begin with a mark (so two keys never overlap within a cluster), and no output holds a sign that
would be rewritten again, so the result is a fixed point.

The text is cut into grapheme clusters (a sign with the marks and invisible signs behind it, or a
run of Hangul letters). A cluster drops its invisible signs, puts its marks into the order that Unicode defines, and is read once from left to
right: the longest key at each place is replaced. Clusters don't depend on each other.

What stays different: case, hiragana and katakana, small and large kana, voicing
marks, circled, raised and squared signs.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from menuflow.session import cut_lineage

# Letters of another script or block, and the sign they look like (see Unicode's table of confusables).
LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТХ": "ABESIJKMHOPCTX",
    "аеорсухіјѕһԁԛԝ": "aeopcyxijshdqw",
    "ҮҺԚԜ": "YhQW",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "οϲϳνρ": "ocjvp",
    "ɡ": "g",
    "ՕՏԼօսհոզց": "OSLouhnqg",
    "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ": "ABCDEHJKLMPRSTVWZ",
    "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ": "IVXLCDMivxlcdm",
    "力工口二八夕卜一": "カエロニハタトー",
    "⺀⺈⺊⺌⺍⺕⺗⺙⺟⺠⺮⺷⺸⺺⻁⻄⻆⻌⻑⻘⻝⻤⻨⻩⻫⻭⻯⻲": "⺀⺈卜⺌⺍彐⺗攵母民竹羊羊隶虎西角辶長青食鬼麦黄斉歯竜亀",
}
WAVE_DASHES = "〜～∼∿〰"
#: Signs that show nothing. Marks that follow a sign are handled with it.
INVISIBLE = r"[\p{Cf}\p{Variation_Selector}͏ᅟᅠㅤﾠ឴឵\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F]"
BLANK = r"[\p{Zs}\p{Zl}\p{Zp}\t\n\v\f\r\u0085]"
#: Half-width voicing marks stand for the combining ones.
HALF_MARKS = {"ﾞ": "゙", "ﾟ": "゚"}


class MappingConflict(ValueError):
    """Two rules give one key different outputs, rules run in a circle, or an output would be rewritten again."""


def rules() -> list[tuple[str, str, str]]:
    """(rule, input, output) of single signs, generated from the Unicode data and :data:`LOOK_ALIKES`."""
    found: list[tuple[str, str, str]] = []
    for code in [*range(0x3000, 0x3001), *range(0xFF01, 0xFFEF)]:
        kind, _, rest = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>") and chr(code) not in HALF_MARKS:
            found.append(("width", chr(code), "".join(chr(int(x, 16)) for x in rest.split())))
    for code in [*range(0x2E80, 0x2FE0), *range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)]:
        usual = unicodedata.normalize("NFKC", chr(code))
        if usual != chr(code):
            found.append(("ideograph", chr(code), usual))
    for code in (0x212A, 0x212B, 0x2126):
        found.append(("letter", chr(code), unicodedata.normalize("NFC", chr(code))))
    for odd, usual in LOOK_ALIKES.items():
        found += [("look-alike", a, b) for a, b in zip(odd, usual) if a != b]
    found += [("wave", c, "~") for c in WAVE_DASHES]
    found += [("width", a, b) for a, b in HALF_MARKS.items()]
    return found


def compile_mapping(given: list[tuple[str, str, str]] | None = None) -> dict[str, str]:
    """The checked table of the rules' inputs. Chains (a width form of a look-alike) are followed to their end.

    Raises :class:`MappingConflict` if an input has two different outputs or rules run in a circle.
    """
    table: dict[str, str] = {}
    for rule, a, b in rules() if given is None else given:
        if table.get(a, b) != b:
            raise MappingConflict(f"{rule}: {a!r} becomes {table[a]!r} and {b!r}")
        table[a] = b
    for a in list(table):
        seen, out = {a}, table[a]
        while any(c in table for c in out):
            new = "".join(table.get(c, c) for c in out)
            if new in seen or len(seen) > 8:
                raise MappingConflict(f"{a!r} runs in a circle")
            seen.add(out)
            out = new
        table[a] = out
    return table


def _composed() -> Iterator[tuple[str, str]]:
    """(sign, its full canonical decomposition) of every sign that is composed of several."""
    for code in [*range(0xC0, 0x3400), *range(0xA000, 0xD7A4), *range(0xF900, 0xFB50), *range(0x10000, 0x12000), *range(0x16000, 0x17000), *range(0x1D000, 0x1D200)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1:
            yield chr(code), parts


class Trie:
    """Strings and their outputs; the longest key at a place is found in one walk."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, out: str) -> None:
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        if node.get("", out) != out:
            raise MappingConflict(f"{key!r} becomes {node['']!r} and {out!r}")
        node[""] = out

    def rewrite(self, text: str) -> str:
        out, i, n = [], 0, len(text)
        while i < n:
            node, j, best, end = self.root, i, text[i], i + 1
            while j < n and text[j] in node:
                node, j = node[text[j]], j + 1
                if "" in node:
                    best, end = node[""], j
            out.append(best)
            i = end
        return "".join(out)


def compile_transducer(given: list[tuple[str, str, str]] | None = None, *, check: bool = False) -> Trie:
    """The automaton of the single rules and of all compositions over them.

    A composed sign's key is its decomposition, and so is every string that differs from it only in a first sign that the rules rewrite to
    the same; the output is the composed sign (or, where that is a rule's input, the rule's output with the marks).
    ``check`` also rewrites every output again, which must change nothing.
    """
    table = compile_mapping(given)
    trie = Trie()
    for a, b in table.items():
        trie.add(a, unicodedata.normalize("NFC", b))
    spelled = defaultdict(list)
    for a, b in table.items():
        if len(a) == 1 and len(b) == 1:
            spelled[b].append(a)
    keys: dict[str, str] = {}
    for sign, parts in _composed():
        base = table.get(parts[0], parts[0])
        out = unicodedata.normalize("NFC", base + parts[1:])
        if sign not in table:
            keys[sign] = out
        for first in (parts[0], base, *spelled[base]):
            keys.setdefault(first + parts[1:], out)
            for half, mark in HALF_MARKS.items():
                if mark in parts[1:]:
                    keys.setdefault(first + parts[1:].replace(mark, half), out)
    for key, out in keys.items():
        if len(key) > 1 and unicodedata.category(key[0])[0] == "M":
            if unicodedata.normalize("NFC", key) != key:
                trie.add(key, out)
            continue
        trie.add(key, out)
    if check:
        again = [(key, out) for key, out in (table | keys).items() if trie.rewrite(unicodedata.normalize("NFD", out)) != unicodedata.normalize("NFC", out)]
        if again:
            raise MappingConflict(f"{len(again)} outputs are rewritten again, such as {again[0]!r}")
    return trie


class Transducer:
    """Applies the automaton to text, cluster by cluster, in one pass."""

    def __init__(self, trie: Trie | None = None):
        self.trie = compile_transducer() if trie is None else trie
        self.invisible = regex.compile(INVISIBLE + "+", regex.V1)
        self.blank = regex.compile(BLANK)
        hangul = r"[ᄀ-ᅞᅡ-ᇿ]"
        #: A run of Hangul letters, or a sign with all marks, half-width voicing marks and invisible signs behind it.
        self.cluster = regex.compile(rf"[ᄀ-ᅞᅡ-ᇿ가-힣](?:{hangul}|{INVISIBLE}|[\p{{M}}ﾞﾟ])*|[^\p{{M}}ﾞﾟ](?:[\p{{M}}ﾞﾟ]|{INVISIBLE})*|(?:[\p{{M}}ﾞﾟ]|{INVISIBLE})+", regex.V1 | regex.DOTALL)
        self.rewrite = lru_cache(1 << 16)(self._rewrite)

    def _rewrite(self, cluster: str) -> str:
        seen = self.invisible.sub("", cluster) if len(cluster) > 1 or self.invisible.match(cluster) else cluster
        if not seen:
            return ""
        if self.blank.match(seen[0]):
            return " " + self._rewrite(seen[1:]) if seen[1:] else " "
        if len(seen) == 1:
            return self.trie.rewrite(seen)
        for half, mark in HALF_MARKS.items():
            seen = seen.replace(half, mark)
        return self.trie.rewrite(unicodedata.normalize("NFD", seen))

    def __call__(self, text: str) -> str:
        """The one form of ``text``, without blanks at either end; a fixed point. Other blanks become spaces, one each."""
        if text.isascii():
            return self.blank.sub(" ", self.invisible.sub("", text)).strip(" ")
        return "".join(map(self.rewrite, self.cluster.findall(text))).strip(" ")


@lru_cache(1)
def transducer() -> Transducer:
    """The transducer of this process, compiled once."""
    return Transducer()


def canonical(text: str | None) -> str | None:
    """The one form of one text; null stays null, invisible text becomes empty."""
    return None if text is None else transducer()(text)


@F.pandas_udf(T.StringType())
def _canonical_batch(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


def canonical_text(c: Column) -> Column:
    """The one form of a text column, by Arrow batches (composition of marks isn't a built-in function)."""
    return _canonical_batch(c)


def look_same(rows: DataFrame, *, scope: str = "chain", key: str = "record_id", text: str = "name") -> DataFrame:
    """(<key>_a, <key>_b, <scope>, form): pairs of one scope whose texts are different strings with the same form.

    The smaller key stands first. Each distinct text of a scope is rewritten once (a step that the optimizer can't copy or
    move); pairs are first formed between distinct texts, so many rows with one and the same text give no candidates, and then
    expanded to the rows: every candidate is a result. Null texts, scopes and keys give no pairs; repeated
    rows give a pair once; blank texts look like each other; a row never pairs with its own key.
    """
    known = rows.select(F.col(scope).alias("_s"), F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.col("_s").isNotNull() & F.col("_k").isNotNull() & F.col("_t").isNotNull())
    kind = known.schema["_s"].dataType.simpleString()

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = transducer()
        for pdf in batches:
            yield pdf.assign(_f=pdf["_t"].map(rewrite))

    told = known.select("_s", "_t").distinct().mapInPandas(forms, f"_s {kind}, _t string, _f string")
    several = told.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_s", "_f"))).where(F.col("_n") > 1).drop("_n")
    ambiguous = cut_lineage(several)
    a, b = ambiguous.withColumnRenamed("_t", "_ta"), ambiguous.withColumnRenamed("_t", "_tb")
    text_pairs = a.join(b, ["_s", "_f"]).where(F.col("_ta") < F.col("_tb"))
    left = known.withColumnsRenamed({"_k": "_ka", "_t": "_ta"}).distinct()
    right = known.withColumnsRenamed({"_k": "_kb", "_t": "_tb"}).distinct()
    pairs = text_pairs.join(left, ["_s", "_ta"]).join(right, ["_s", "_tb"]).where(F.col("_ka") != F.col("_kb"))
    return pairs.select(F.least("_ka", "_kb").alias(f"{key}_a"), F.greatest("_ka", "_kb").alias(f"{key}_b"), F.col("_s").alias(scope), F.col("_f").alias("form")).distinct()
