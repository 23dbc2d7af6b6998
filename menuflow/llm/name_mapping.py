"""Names as typed, mapped to the items of a reference list.

Distinct values are normalised, candidates come from an inverted index of character n-grams, and the
weighted cosine decides: an entry means the item with the greatest cosine if that is at least ``threshold``
and at least ``margin`` above the next item's; otherwise it means none and is reported so.

What makes the cosine tell a misspelling from another dish is the weight of an n-gram, which is learned from the reference
list (:func:`learn`): names are cut into *components* (words that recur in many names, found by a unigram model), each
component has the mass 1, spread evenly over its n-grams, and an n-gram weighs what it has on average where it
occurs. So n-grams across two components, and those that the list lacks (errors, additions), weigh nothing or little, and a
foreign component counts as much as a missing one, however long either is.

Other ways of writing a component are learned as well (:func:`equivalences`), from the entries: a stretch that stands, in many
different names, exactly where one and the same component is missing.

Plan: what is learned is bounded whatever the number of rows, since it is cut by *shares* of the names (1 / share
components, 1 / share equivalences), and is counted by Spark over all rows. An entry's value
meets an item only by n-grams that are among the rarest of both: those before the point from which the rest can't reach the
threshold any more (exact for the cosine). Scope is the chain, or all chains for entries without one; that scope's
postings are salted. Of the candidates of a value only the two best are ranked.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menuflow.llm.visual_text import canonical
from menuflow.session import cut_lineage

_SIGNS = re.compile(r"[\W_]+")
#: What an unknown sign costs when a name is cut into words; more than any word.
UNKNOWN = 40.0


def fold(text: str | None) -> str:
    """Visual form, compatibility form, lower case, hiragana; no blanks or signs."""
    t = unicodedata.normalize("NFKC", canonical(text) or "").lower()
    return _SIGNS.sub("", "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in t))


def split_words(name: str, cost: dict[str, float], longest: int, unknown: float = UNKNOWN) -> list[str]:
    """The cheapest way to cut ``name`` into words of ``cost``; unknown signs stand alone and cost ``unknown``."""
    best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
    for j in range(1, len(name) + 1):
        for i in range(max(0, j - longest), j):
            c = best[i] + cost.get(name[i:j], unknown if j - i == 1 else math.inf)
            if c < best[j]:
                best[j], back[j] = c, i
    out, j = [], len(name)
    while j:
        out.append(name[back[j] : j])
        j = back[j]
    return out[::-1]


def word_costs(scores: dict[str, float]) -> dict[str, float]:
    """Minus the logarithm of each word's share, and a fee for each word, so that few long words beat many short ones."""
    total = math.log(sum(scores.values()) or 1)
    return {w: total - math.log(c) + 3 for w, c in scores.items()}


def grams(text: str) -> list[str]:
    """The 1-grams and 2-grams of a text, as often as they stand there."""
    return [*text, *(text[i : i + 2] for i in range(len(text) - 1))]


def component_grams(word: str) -> list[str]:
    """The n-grams that carry a component: its 2-grams, or the sign itself if it has one only."""
    return [word[i : i + 2] for i in range(len(word) - 1)] or [word]


@dataclass
class Language:
    """What is learned of a reference list: components with costs, and n-grams with weights and numbers in order of rarity."""

    cost: dict[str, float]
    weight: dict[str, float]
    longest: int
    same: dict[str, str]

    def __post_init__(self) -> None:
        self.number = {g: i for i, g in enumerate(self.weight)}
        self.every = self.cost | {r: self.cost[w] for r, w in self.same.items()}
        self.reach = max(map(len, self.every), default=1)

    def parts(self, key: str) -> tuple[list[str], list[str]]:
        """(components, stretches between them) of a folded name."""
        known, rest, open_ = [], [], ""
        for p in split_words(key, self.cost, self.longest):
            if p in self.cost:
                known.append(p)
                rest, open_ = ([*rest, open_] if open_ else rest), ""
            else:
                open_ += p
        return known, [*rest, open_] if open_ else rest

    def usual(self, key: str) -> str:
        """The folded name with learned equivalents replaced by their components."""
        return "".join(self.same.get(p, p) for p in split_words(key, self.every, self.reach)) if self.same else key

    def vector(self, key: str) -> list[tuple[int, int, float]]:
        """(number, occurrences, weight of one) of the name's n-grams that weigh anything, rarest first."""
        return sorted((self.number[g], n, self.weight[g]) for g, n in Counter(grams(self.usual(key))).items() if g in self.number)


def _per_batch(f: Callable[[list], list], columns: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(f(pdf.iloc[:, 0].tolist()), columns=names)

    return run


def learn(keys: DataFrame, *, longest: int = 12, rounds: int = 3, first_share: float = 0.003, share: float = 0.007) -> Language:
    """The components and n-gram weights of the folded names in the only column of ``keys``, counted over all of them.

    Words have at most ``longest`` signs (longer ones are learned in parts). Candidates are the substrings in at least
    ``first_share`` of the names; ``rounds`` times the names are cut at the least cost and the words counted anew;
    components stand for at least ``share`` of the names (single signs for twice that). So there are at most mean length x
    ``longest`` / ``first_share`` candidates and mean length / ``share`` components, however many names there are.
    """
    name = keys.columns[0]
    keys = cut_lineage(keys.where(F.length(name) > 0))
    many = keys.count()
    length = F.length(name)
    ends = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), length - i + 1)), lambda n: F.substring(name, i, n))
    found = keys.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), length), ends))).alias("w")).groupBy("w").count()
    scores = {r["w"]: float(r["count"] * len(r["w"]) ** 2) for r in found.where(F.col("count") >= first_share * many).collect()}  # bounded by the share
    for i in range(rounds):
        cost, rare = word_costs(scores), math.log(sum(scores.values()) or 1) - math.log(0.5) + 3
        words = keys.mapInPandas(_per_batch(lambda names, cost=cost, rare=rare: list(Counter(w for n in names for w in split_words(n, cost, longest, rare)).items()), "w string, n bigint"), "w string, n bigint")
        floor = (share if i == rounds - 1 else first_share) * many
        scores = {r["w"]: float(r["n"]) for r in words.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).collect()}  # likewise
    cost = word_costs({w: c for w, c in scores.items() if len(w) > 1 or c >= 2 * share * many})

    def weigh(names: list[str]) -> list[tuple]:
        mass: dict[str, float] = defaultdict(float)
        count: Counter = Counter()
        for n in names:
            count.update(grams(n))
            for w in split_words(n, cost, longest):
                if w in cost:
                    own = component_grams(w)
                    for g in own:
                        mass[g] += 1 / len(own)
        return [(g, mass[g], c) for g, c in count.items() if g in mass]

    weights = keys.mapInPandas(_per_batch(weigh, "g string, m double, n bigint"), "g string, m double, n bigint").groupBy("g").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    told = sorted(weights.collect(), key=lambda r: (r["n"], r["g"]))  # n-grams of components only
    return Language(cost, {r["g"]: math.sqrt(r["m"] / r["n"]) for r in told}, longest, {})


def equivalences(language: Language, items: DataFrame, values: DataFrame, *, share: float = 0.001, purity: float = 0.8, least: int = 3) -> dict[str, str]:
    """Other ways of writing a component, learned from ``values`` (_scope, _key) and ``items`` (_scope, _item).

    A value that is some components and one other stretch votes, with that stretch, for the component that an item of its scope has beside
    the same components. A stretch counts as written for a component with at least ``least`` votes and ``share``
    of all votes, of which ``purity`` go to that component; stretches that lie within it (a shortened or damaged one) don't. At most 1 / ``share`` result.
    """

    def lacking(keys: list[str]) -> list[tuple]:
        out = []
        for k in keys:
            known = sorted(language.parts(k)[0])
            out += [(k, "\0".join(known[:i] + known[i + 1 :]), w) for i, w in enumerate(known) if len(known) > 1]
        return out

    def one_stretch(keys: list[str]) -> list[tuple]:
        out = []
        for k in keys:
            known, rest = language.parts(k)
            if known and len(rest) == 1:
                out.append((k, "\0".join(sorted(known)), rest[0]))
        return out

    item_parts = items.select("_item").distinct().mapInPandas(_per_batch(lacking, "_item string, _has string, _word string"), "_item string, _has string, _word string")
    value_parts = values.select("_key").distinct().mapInPandas(_per_batch(one_stretch, "_key string, _has string, _rest string"), "_key string, _has string, _rest string")
    missing = items.join(item_parts, "_item").select("_scope", "_has", "_word").distinct()
    stretches = values.join(value_parts, "_key").select("_scope", "_has", "_rest").distinct()
    votes = cut_lineage(stretches.join(missing, ["_scope", "_has"]).groupBy("_rest", "_word").agg(F.count(F.lit(1)).alias("n")))
    total = votes.agg(F.sum("n")).first()[0] or 0
    by = votes.groupBy("_rest").agg(F.sum("n").alias("_all"), F.max(F.struct("n", "_word")).alias("_b")).where((F.col("_b.n") >= max(least, share * total)) & (F.col("_b.n") >= purity * F.col("_all")))
    return {r["_rest"]: r["_b"]["_word"] for r in by.collect() if r["_rest"] not in r["_b"]["_word"]}  # bounded by the share


def _vectors(rows: DataFrame, key: str, language: Language, least: float) -> DataFrame:
    """``rows`` with the vectors of their folded names: _norm; _ids, the numbers of its n-grams, as often as they occur; _parts, what one
    occurrence of each adds to the product with a vector that has it (its weight squared, times the occurrences here); and _prefix: the first n-grams, of which two names of a cosine of
    ``least`` or more share at least one: what a name has behind them, in the common order of rarity, is shorter than ``least`` of its norm."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _norm double, _ids array<int>, _parts map<int,double>, _prefix array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            norms, ids, parts, prefixes = [], [], [], []
            for k in pdf[key]:
                v = language.vector(k)
                rest = total = sum((n * w) ** 2 for _, n, w in v)
                end = 0
                while end < len(v) and rest >= least * least * total * (1 - 1e-9):
                    rest -= (v[end][1] * v[end][2]) ** 2
                    end += 1
                norms.append(math.sqrt(total))
                ids.append([i for i, n, _ in v for _ in range(n)])
                parts.append({i: n * w * w for i, n, w in v})
                prefixes.append([i for i, _, _ in v[:end]])
            yield pdf.assign(_norm=norms, _ids=ids, _parts=parts, _prefix=prefixes)

    return rows.mapInPandas(run, schema).where("_norm > 0")


def _folded(names: DataFrame, to: str) -> DataFrame:
    """(the only column of ``names``, its folded form as ``to``) of distinct names, each folded once, in a step that the optimizer can't copy."""
    name = names.columns[0]
    columns = f"{name} string, {to} string"
    return cut_lineage(names.where(F.col(name).isNotNull()).distinct().mapInPandas(_per_batch(lambda x: [(n, fold(n)) for n in x], columns), columns))


def map_names(
    entries: DataFrame,
    reference: DataFrame,
    *,
    entry: str = "entry_id",
    name: str = "name",
    scope: str = "chain",
    ref: str = "ref_id",
    ref_name: str = "canonical_name",
    threshold: float = 0.79,
    margin: float = 0.05,
    salts: int = 4,
    learn_same: bool = True,
) -> DataFrame:
    """(entry, ref, score): the item each entry means, -1 where it means none, with its cosine; one row per entry.

    Null, blank and unknown names mean none. An entry without a scope is looked up among all items, one with a scope
    that the reference lacks means none, and so does one whose best item's cosine isn't ``margin`` above any other item's: an ambiguous name, or a name that several
    items of the scope share. Of repeated rows of an entry with different names the greatest ref stands. Items
    with a null name aren't looked up. Empty reference: every entry gets -1. Other columns are ignored.
    """
    scoped = lambda c: F.when(F.col(c).isNull(), F.lit("*")).otherwise(F.concat(F.lit("="), c))
    known = reference.where(F.col(ref_name).isNotNull() & F.col(ref).isNotNull()).select(F.col(ref).cast("bigint").alias("_ref"), scoped(scope).alias("_own"), F.col(ref_name).alias("_name"))
    items = cut_lineage(known.join(_folded(known.select("_name"), "_item"), "_name").where(F.col("_item") != "").select("_own", "_ref", "_item").distinct())
    scoped_items = items.select(F.explode(F.array_distinct(F.array("_own", F.lit("*")))).alias("_scope"), "_ref", "_item")
    language = learn(items.select("_item").distinct())

    rows = entries.where(F.col(entry).isNotNull()).select(F.col(entry), scoped(scope).alias("_scope"), F.col(name).alias("_name"))
    forms = _folded(rows.select("_name"), "_key").where(F.col("_key") != "")
    told = cut_lineage(rows.where(F.col("_name").isNotNull()).select("_scope", "_name").distinct().join(forms, "_name"))
    values = told.select("_scope", "_key").distinct()
    if learn_same:
        language = replace(language, same=equivalences(language, scoped_items.select("_scope", "_item"), values))

    salt = F.when(F.col("_scope") == "*", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int")).otherwise(0)
    salted = F.when(F.col("_scope") == "*", F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    vectors = _vectors(items, "_item", language, threshold - margin).select("_own", "_ref", F.col("_norm").alias("_inorm"), F.col("_parts").alias("_iv"), "_prefix")
    index = vectors.select(F.explode(F.array_distinct(F.array("_own", F.lit("*")))).alias("_scope"), "_ref", "_inorm", "_iv", "_prefix")
    index = index.select("_scope", F.explode(salted).alias("_salt"), "_ref", "_inorm", "_iv", "_prefix").select("_scope", "_salt", "_ref", "_inorm", "_iv", F.explode("_prefix").alias("_g"))
    asked = _vectors(values, "_key", language, threshold - margin).select("_scope", "_key", salt.alias("_salt"), "_norm", "_ids", F.explode("_prefix").alias("_g"))
    dot = F.aggregate("_ids", F.lit(0.0), lambda acc, i: acc + F.coalesce(F.try_element_at("_iv", i), F.lit(0.0)))
    cosine = F.round(dot / (F.col("_norm") * F.col("_inorm")), 9)
    near = asked.join(index, ["_scope", "_salt", "_g"]).select("_scope", "_key", "_ref", cosine.alias("_cos")).where(F.col("_cos") >= threshold - margin).distinct()
    order = Window.partitionBy("_scope", "_key").orderBy(F.desc("_cos"), "_ref")
    two = near.withColumn("_r", F.row_number().over(order)).where("_r <= 2").groupBy("_scope", "_key").agg(
        F.max(F.when(F.col("_r") == 1, F.struct("_cos", "_ref"))).alias("_b"), F.max(F.when(F.col("_r") == 2, F.col("_cos"))).alias("_next")
    )
    clear: Column = (F.col("_b._cos") >= threshold) & (F.col("_b._cos") - F.coalesce("_next", F.lit(-1.0)) >= margin)
    meant = told.join(two.where(clear), ["_scope", "_key"]).select("_scope", "_name", "_b._ref", F.col("_b._cos").alias("score"))
    found = rows.join(meant, ["_scope", "_name"], "left")
    return found.groupBy(entry).agg(F.max(F.struct(F.coalesce("_ref", F.lit(-1).cast("bigint")).alias(ref), "score")).alias("_m")).select(entry, "_m.*")
