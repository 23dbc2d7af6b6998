"""Document and paragraph languages by rank-order profiles.

A language's profile is the order of its most frequent character n-grams. A paragraph's
own most frequent n-grams are compared with each profile by the out-of-place distance: the sum,
over its n-grams, of how far their ranks lie apart, with a fixed penalty for n-grams that the
profile lacks. The nearest profile wins; the confidence is the margin to the next.

Profiles are fitted on a bounded sample of labelled rows (``sample_rows`` of each language, those with the
smallest hashes of the keys), twice: the second time with the languages that the first profiles give the
sample's paragraphs, so wrong labels and mixed documents don't blur them. The sample's keys are chosen from keys and labels alone, its
texts are read once and kept. Then every document is judged, whole, in one pass without a shuffle, equal
paragraphs of a batch once. The profiles are languages x ``size`` entries.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menuflow.session import broadcast_if_small, cut_lineage, spread

LANGUAGES = ("ja", "en", "zh", "ko", "fr", "de", "es", "pt")
#: Markup, entities and addresses tell nothing about the language around them.
NOISE = re.compile(r"https?://[!-~]+|</?[A-Za-z!?|][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6});|[!-?A-~]+@[!-?A-~]+")
WORDS = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
BREAK = re.compile(r"[\r\n]+")
SCRIPT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")

Profile = dict[str, int]


def paragraphs(text: str | None) -> list[str]:
    """The non-blank stretches between line breaks (CR, LF)."""
    return [p for p in BREAK.split(text or "") if p.strip()]


def _quiet(text: str) -> str:
    """The text in lower case without markup, entities and addresses."""
    return (NOISE.sub(" ", text) if "<" in text or "&" in text or "@" in text or "://" in text else text).lower()


def grams(text: str, longest: int = 3) -> list[str]:
    """The n-grams of 1 to ``longest`` signs in the words of ``text``, as often as they stand there; words in alphabets are padded."""
    found: list[str] = []
    for word in WORDS.findall(_quiet(text)):
        w = word if SCRIPT.search(word) else f"_{word}_"
        for n in range(1, longest + 1):
            found += [w[i : i + n] for i in range(len(w) - n + 1)]
    return found


def _mainly_asian(text: str) -> bool:
    words = WORDS.findall(NOISE.sub(" ", text))
    asian = sum(len(SCRIPT.findall(w)) for w in words)
    last = bool(SCRIPT.match(words[-1][-1]))
    return asian * 1.5 + 5 * last > sum(map(len, words)) - asian + 5 * (not last)


def _word_signs() -> np.ndarray:
    """Per code point: 1 letter or mark, 2 one of an Asian script (:data:`SCRIPT`), 4 an apostrophe, else 0."""
    kind = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    codes = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    for value, pattern in ((1, regex.compile(r"[\p{L}\p{M}]+")), (3, regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}&&[\p{L}\p{M}]]+", regex.V1))):
        for m in pattern.finditer(every):
            kind[codes[m.start() : m.end()]] = value
    kind[[ord("'"), ord("’")]] = 4
    return kind


class Judge:
    """Profiles as one matrix of ranks, n-grams by languages. Many paragraphs are judged at once, in whole arrays: their n-grams are sorted as
    numbers of three code points, counted, ranked within their paragraph and looked up."""

    signs: np.ndarray | None = None

    def __init__(self, profiles: dict[str, Profile], size: int):
        self.size, self.languages = size, sorted(profiles)
        every = sorted({g for p in profiles.values() for g in p})
        self.known = np.array([sum(ord(c) << (42 - 21 * i) for i, c in enumerate(g)) for g in every], np.int64)
        self.ranks = np.array([[profiles[lang].get(g, -1) for lang in self.languages] for g in every], np.float64).reshape(len(every), len(self.languages))
        self.asian = {lang for lang in self.languages if sum(bool(SCRIPT.match(g)) for g in profiles[lang]) * 2 > len(profiles[lang])}
        if Judge.signs is None:
            Judge.signs = _word_signs()

    def _padded(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code points of all words, words in alphabets between underscores, a 0 behind each word; the text of each position)."""
        clean = [_quiet(t) for t in texts]
        codes = np.frombuffer("\n".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(clean)), [len(t) + 1 for t in clean])[: len(codes)]
        kind = self.signs[codes]
        letter = (kind & 1).astype(bool)
        inside = letter.copy()
        inside[1:-1] |= (kind[1:-1] == 4) & letter[:-2] & letter[2:]
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        before = np.concatenate([[0], np.cumsum(kind == 3)])
        padded = (before[stop] == before[start]).astype(np.int64)
        length = stop - start + 2 * padded + 1
        end = np.cumsum(length)
        out = np.zeros(end[-1], np.int64)
        at = end - length
        place = np.flatnonzero(inside)
        word = np.repeat(np.arange(len(start)), stop - start)
        out[place - start[word] + at[word] + padded[word]] = codes[place]
        wide = padded.astype(bool)
        out[at[wide]] = out[end[wide] - 2] = ord("_")
        return out, np.repeat(own[start], length)

    def counted(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, n-gram as a number, count) of the 1- to 3-grams of many texts, ordered by text and code points."""
        codes, own = self._padded(texts)
        if not len(codes):
            return (np.empty(0, np.int64),) * 3
        signs, a = np.unique(codes, return_inverse=True)  # 0, which separates words, is the least
        bits = max(1, int(len(signs)).bit_length())
        b, c = np.append(a[1:], 0), np.append(a[2:], (0, 0)) if len(a) > 1 else np.zeros(1, a.dtype)
        one, two = (a > 0) & (codes != ord("_")), (a > 0) & (b > 0)
        three = two & (c > 0)
        head = own << (3 * bits)
        every = np.concatenate([(head | a << 2 * bits)[one], (head | a << 2 * bits | b << bits)[two], (head | a << 2 * bits | b << bits | c)[three]])
        every.sort()
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(every)))
        every, mask = every[first], (1 << bits) - 1
        gram = signs[every >> 2 * bits & mask] << 42 | signs[every >> bits & mask] << 21 | signs[every & mask]
        return every >> 3 * bits, gram, count

    def distances(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(has any n-gram that a profile has; mean out-of-place distance to each profile) of many texts, from 0 to ``size``, over
        each text's ``size`` most frequent n-grams (ties in code-point order); equally frequent ones share their mean rank."""
        n, known = len(texts), self.known
        text, gram, count = self.counted(texts)
        total = np.zeros((n, len(self.languages)))
        has, own_n = np.zeros(n, np.int64), np.ones(n, np.int64)
        if not len(text) or not len(known):
            return has > 0, total
        order = np.lexsort((-count, text))  # stable: equal counts stay in code-point order
        text, gram, count = text[order], gram[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        rank = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
        top = rank < self.size
        text, gram, count, rank = text[top], gram[top], count[top], rank[top]
        tie = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (count[1:] != count[:-1])]))
        many = np.diff(np.append(tie, len(text)))
        mean = np.repeat(rank[tie] + (many - 1) / 2, many)
        own_n = np.maximum(np.bincount(text, minlength=n), 1)
        row = np.searchsorted(known, gram).clip(max=len(known) - 1)
        hit = known[row] == gram
        r, t = self.ranks[row[hit]], text[hit]
        off = np.where(r < 0, self.size, np.abs(r - mean[hit][:, None]))
        for i in range(len(self.languages)):
            total[:, i] = np.bincount(t, off[:, i], n)
        has = np.bincount(t, minlength=n)
        return has > 0, (total + ((own_n - has) * self.size)[:, None]) / own_n[:, None]

    def many(self, texts: Sequence[str], close: float = 0.05, most_signs: int = 1 << 19) -> list[tuple[str | None, float, np.ndarray]]:
        """(language, confidence, distances) of each text; no language for a text without words or without any n-gram of the profiles.

        The confidence is four times the relative margin to the next language, at most 1. If two languages of different
        scripts lie within ``close`` of each other, letters decide: those of the last word's script count five more, Asian ones half as much again.
        Texts are taken together up to ``most_signs``; a longer one stands alone.
        """
        out: list[tuple[str | None, float, np.ndarray]] = []
        part: list[str] = []
        signs = 0
        for i, t in enumerate(texts):
            part.append(t)
            signs += len(t)
            if signs < most_signs and len(part) < 8192 and i + 1 < len(texts):
                continue
            has, all_d = self.distances(part)
            order = np.argsort(all_d, axis=1, kind="stable")
            for p, ok, d, o in zip(part, has.tolist(), all_d, order.tolist()):
                if not ok:
                    out.append((None, 0.0, d))
                    continue
                first, next_ = o[0], o[1] if len(o) > 1 else None
                second = float(d[next_]) if next_ is not None else float(self.size)
                margin = (second - float(d[first])) / max(second, 1e-9)
                if next_ is not None and margin < close:
                    a, b = (self.languages[x] in self.asian for x in (first, next_))
                    if a != b and _mainly_asian(p) == b:
                        first = next_
                out.append((self.languages[first], round(min(1.0, margin * 4), 4), d))
            part, signs = [], 0
        return out

    def __call__(self, text: str) -> tuple[str | None, float, dict[str, float]]:
        """(language, confidence, distances by language) of one text."""
        to, sure, d = self.many([text])[0]
        return to, sure, dict(zip(self.languages, d.tolist())) if to else {}


def language_part(c: Column) -> Column:
    """``ja`` of ``JA_jp``: the language part in lower case; null where there is none (null, empty, und)."""
    part = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(part.isin("", "und", "unk", "mul", "zxx", "mis"), None).otherwise(part)


def _top(counted: DataFrame, size: int, ratio: float) -> dict[str, Profile]:
    """The profiles of counted n-grams. An n-gram belongs to a language if its share there is at least ``ratio`` of its greatest share in any language: what wrong labels carry over stays out."""
    total, best = Window.partitionBy("lang"), Window.partitionBy("gram")
    order = total.orderBy(F.desc("n"), "gram")
    shares = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(total))
    own = shares.withColumn("best", F.max("share").over(best)).where(F.col("share") >= ratio * F.col("best"))
    found: dict[str, Profile] = defaultdict(dict)
    for r in own.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).collect():  # at most languages x size
        found[r["lang"]][r["gram"]] = r["r"] - 1
    return dict(found)


def fit_profiles(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str = "lang", languages: Sequence[str] = LANGUAGES, size: int = 400, sample_rows: int = 1000, ratio: float = 0.5) -> dict[str, Profile]:
    """The profiles of ``languages``, fitted on at most ``sample_rows`` labelled rows of each, those with the smallest hash of the key; languages nobody labelled have none."""
    keys = documents.select(F.col(doc).alias("doc"), language_part(F.col(lang)).alias("lang")).where(F.col("lang").isin(*languages) & F.col("doc").isNotNull()).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc"), "doc")
    chosen = keys.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample_rows).select("doc", "lang")
    texts = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text"), language_part(F.col(lang)).alias("lang"))
    tasks = documents.sparkSession.sparkContext.defaultParallelism  # few rows, but each costs time
    sample = cut_lineage(texts.join(broadcast_if_small(chosen, len(languages) * sample_rows), ["doc", "lang"], "left_semi").where(F.length("text") > 0).repartition(tasks, "doc"))

    def count(profiles: dict[str, Profile] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            judge = Judge(profiles or {}, size)
            for pdf in batches:
                parts = [(p, label) for t, label in zip(pdf["text"], pdf["lang"]) for p in paragraphs(t)]
                told = judge.many([p for p, _ in parts]) if profiles else None
                by: dict[str, list[str]] = defaultdict(list)
                for i, (p, label) in enumerate(parts):
                    if to := told[i][0] if told else label:
                        by[to].append(p)
                for to, own in by.items():
                    _, gram, n = judge.counted(["\n".join(own)])
                    names = ["".join(chr(g >> k & 0x1FFFFF) for k in (42, 21, 0)).rstrip("\0") for g in gram.tolist()]
                    yield pd.DataFrame({"lang": to, "gram": names, "n": n})

        return run

    schema = "lang string, gram string, n bigint"
    first = _top(sample.mapInPandas(count(None), schema), size, ratio)
    return _top(sample.mapInPandas(count(first), schema), size, ratio) if first else {}


def identify(
    documents: DataFrame, profiles: dict[str, Profile], *, doc: str = "doc_id", text: str = "text", lang: str = "lang", size: int = 400, inherit: float = 0.03
) -> DataFrame:
    """(doc, label, paragraph, lang, confidence, chars, mixed): one row for each document (paragraph 0) and each of its paragraphs.

    ``label`` is the language part of the given label. A document's language is the one that most characters
    of its paragraphs are written in; its confidence is the mean of those paragraphs' weighted by characters, times their share.
    A paragraph that lies within ``inherit`` (relative) of the document's language takes that language: a foreign
    name doesn't change it. ``mixed`` says whether the document has paragraphs in two languages. Null, empty and wordless texts
    give no rows, nor do wordless paragraphs, which keep their number. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(profiles, size)
        place = {x: i for i, x in enumerate(judge.languages)}
        for pdf in batches:
            out = []
            split = [paragraphs(t) for t in pdf["t"]]
            distinct = {p: i for i, p in enumerate(dict.fromkeys(p for ps in split for p in ps))}
            told = judge.many(list(distinct))
            for d, label, ps in zip(pdf["d"], pdf["l"], split):
                parts = [(i, len(p.strip()), *told[distinct[p]]) for i, p in enumerate(ps, 1)]
                parts = [x for x in parts if x[2]]
                if not parts:
                    continue
                chars: Counter = Counter()
                for _, n, to, _, _ in parts:
                    chars[to] += n
                main = min(chars, key=lambda x: (-chars[x], x))
                settled = []
                for i, n, to, sure, dist in parts:
                    near = to != main and dist[place[main]] <= dist[place[to]] * (1 + inherit)
                    settled.append((i, n, main if near else to, sure))
                own = [x for x in settled if x[2] == main]
                total, mine = sum(x[1] for x in settled), sum(x[1] for x in own)
                mixed = len({x[2] for x in settled}) > 1
                out.append((d, label, 0, main, round(sum(x[1] * x[3] for x in own) / max(mine, 1) * mine / max(total, 1), 4), total, mixed))
                out += [(d, label, i, to, sure, n, mixed) for i, n, to, sure in settled]
            yield pd.DataFrame(out, columns=["doc", "label", "paragraph", "lang", "confidence", "chars", "mixed"])

    kind = documents.schema[doc].dataType.simpleString()
    given = spread(documents).where(F.col(text).isNotNull()).select(F.col(doc).alias("d"), language_part(F.col(lang)).alias("l"), F.col(text).alias("t"))
    found = given.mapInPandas(run, f"doc {kind}, label string, paragraph int, lang string, confidence double, chars bigint, mixed boolean")
    return found.withColumnRenamed("doc", doc)


def corrections(found: DataFrame) -> DataFrame:
    """Of :func:`identify`'s rows: documents whose label is missing or wrong, and all paragraphs of mixed documents."""
    return found.where(((F.col("paragraph") == 0) & ~F.col("lang").eqNullSafe(F.col("label"))) | ((F.col("paragraph") > 0) & F.col("mixed")))
