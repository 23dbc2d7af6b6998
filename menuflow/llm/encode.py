"""Encoding of a corpus with a public byte-level BPE tokenizer, each shared chunk once.

Texts are cut into chunks where a rolling hash of the last signs says so, so equal
passages of different documents give equal chunks wherever they stand. A chunk's
inner part - from the first to the last *certain* token boundary in it - has the same
tokens in every text. Around each cut, the stretch from the last certain boundary
before it to the first one after it is encoded anew: that repairs the join, and since
both ends are certain the result agrees exactly with encoding the whole
text. Where a chunk has no certain boundary the stretch runs on into the next chunk.

A boundary between two signs is certain if the tokenizer's pattern has to split there whatever stands
around: between letter, number, other sign in any change (but not behind an apostrophe), and before
blanks. Signs outside the long-settled blocks never count as certain, so the Unicode version of the
tokenizer doesn't matter.

Plan: one pass cuts the texts, each once; a piece travels with the places it stands at, once for each batch of
documents that holds it, to the task of its key, where it is encoded once and its ids go to all its places; a
second shuffle gathers the ids by document. Ids travel in 16 bits where the vocabulary allows it. A piece that is *hot* in a batch (it stands at more than a
:data:`HOT` th of the batch's places) is salted by the batch, so its places are spread over :data:`SALTS` tasks, and it is encoded at most
that often. Sizes alone need no second shuffle of ids: only their number travels. Nothing is collected.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menuflow.session import spread

TOKENIZER_FOLDER = "/opt/tokenizers"
#: A public pattern: how the tokenizer splits text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 12
#: A piece is hot if it stands at more than one in HOT places of a batch; its places are then spread over SALTS tasks.
HOT, SALTS = 50, 16
#: How many places travel in one row at most, and how many ids are held before they are handed on.
PLACES, HELD_IDS = 256, 1 << 20
LETTER, NUMBER, OTHER, BLANK, UNSURE, APOSTROPHE = range(6)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point; UNSURE outside blocks whose signs are all long settled."""
    out = np.full(0x110000, UNSURE, np.uint8)
    for lo, hi in ((0x20, 0x7F), (0xA0, 0x370), (0x3000, 0x3100), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xFF01, 0xFFBF), (0x0400, 0x0480), (0x2010, 0x2028)):
        for code in range(lo, hi):
            kind = unicodedata.category(chr(code))
            if kind not in ("Cn", "Zl", "Zp"):
                out[code] = BLANK if kind == "Zs" else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    for code in (0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        out[code] = BLANK
    out[ord("'")] = APOSTROPHE
    return out


@lru_cache(4)
def encoder(folder: str, name: str):
    """The tokenizer ``name`` of ``folder``: a file of base64 tokens and ranks; no special tokens, so all text is ordinary."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def certain_boundaries(codes: np.ndarray) -> np.ndarray:
    """Positions i (0 < i < n) where a token boundary stands before sign i in any text that holds these two signs."""
    if len(codes) < 2:
        return np.empty(0, np.int64)
    kinds = _classes()[codes]
    a, b = kinds[:-1], kinds[1:]
    sure = (a != UNSURE) & (b != UNSURE) & (a != BLANK) & (a != APOSTROPHE) & (a != b)
    # an apostrophe is an "other" sign: between it and another such sign there is no boundary
    sure &= ~((a == OTHER) & (b == APOSTROPHE))
    return np.flatnonzero(sure) + 1


def hash_cuts(codes: np.ndarray, mean: int) -> np.ndarray:
    """Positions at which a hash of the last :data:`WINDOW` signs is a multiple of ``mean`` (a power of two)."""
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    wide = codes.astype(np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + wide[j : j + n] * np.uint64(factor)
    h ^= h >> np.uint64(29)
    return np.flatnonzero((h * np.uint64(factor)) >> np.uint64(40) & np.uint64(mean - 1) == 0) + WINDOW


def pieces(text: str, mean: int = 128) -> list[str]:
    """The text as chunk interiors and join stretches in turn; their encodings, in order, are the text's encoding."""
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = hash_cuts(codes, mean)
    if not len(cuts):
        return [text]
    sure = certain_boundaries(codes)
    if not len(sure):
        return [text]
    at = np.searchsorted(sure, cuts)  # first certain boundary at or after each cut
    before = np.where(at > 0, sure[np.maximum(at - 1, 0)], 0)
    after = np.where(at < len(sure), sure[np.minimum(at, len(sure) - 1)], len(codes))
    edges = np.unique(np.concatenate([[0, len(codes)], before, after]))
    return [text[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _cut(documents: DataFrame, doc: str, text: str, mean: int, most_signs: int = 1 << 20) -> DataFrame:
    """(key, salt, piece, docs, versions, places): the pieces of each batch of documents with the places they stand at, in the order of the arrays.

    Every document stands in at least one row, empty and null ones with the empty piece; version tells rows of one document with different texts
    apart. A batch is cut off after ``most_signs`` signs.
    """
    kind = documents.schema[doc].dataType.simpleString()
    columns = f"key binary, salt int, piece string, docs array<{kind}>, versions array<bigint>, places array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_type = batch.schema.field("d").type
            held: dict[str, tuple[list, list, list]] = {}
            signs = places = 0

            def out() -> pa.RecordBatch:
                rows = []
                for p, at in held.items():
                    key = hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    hot = len(at[0]) > 8 and len(at[0]) * HOT > places
                    for i in range(0, len(at[0]), PLACES):
                        rows.append((key, (task + number + i // PLACES) % SALTS if hot else 0, p, *(x[i : i + PLACES] for x in at)))
                kinds = (pa.binary(), pa.int32(), pa.string(), pa.list_(doc_type), pa.list_(pa.int64()), pa.list_(pa.int32()))
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "salt", "piece", "docs", "versions", "places"])

            for d, v, t in zip(batch["d"].to_pylist(), batch["v"].to_pylist(), batch["t"].to_pylist()):
                for i, p in enumerate(pieces(t, mean) if t else ("",)):
                    at = held.get(p)
                    if at is None:
                        at = held[p] = ([], [], [])
                    at[0].append(d)
                    at[1].append(v)
                    at[2].append(i)
                    places += 1
                signs += len(t or "")
                if signs > most_signs:
                    yield out()
                    held, signs, places, number = {}, 0, 0, number + 1
            if held:
                yield out()
                number += 1

    given = spread(documents).select(F.col(doc).alias("d"), F.xxhash64(text).alias("v"), F.col(text).alias("t"))
    return given.mapInArrow(run, columns)


def encoded_pieces(
    documents: DataFrame, *, doc: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_FOLDER, mean: int = 128, counts: bool = False
) -> DataFrame:
    """(doc, version, pos, ids), or with ``counts`` (doc, version, pos, n): every piece of every document; each distinct piece is encoded once.

    ``ids`` holds 16-bit numbers less 32,768 where the vocabulary has at most 65,536 tokens (see :func:`gather`), so that less is shuffled.
    """
    kind = documents.schema[doc].dataType.simpleString()
    narrow = _narrow(tokenizer, folder)
    value = "n int" if counts else f"ids array<{'smallint' if narrow else 'int'}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, tokenizer).encode_ordinary
        kind = np.int16 if narrow else np.int32
        last, ids = None, np.empty(0, kind)
        for batch in batches:
            times = pc.list_value_length(batch["docs"]).to_pylist()
            start, values, held = 0, [], 0
            for i, (key, piece, n) in enumerate(zip(batch["key"].to_pylist(), batch["piece"].to_pylist(), times), 1):
                if key != last:
                    last, ids = key, np.array(encode(piece), np.int64)
                    ids = (ids - 32768).astype(kind) if narrow else ids.astype(kind)
                values.append(ids)
                held += len(ids) * n
                if held < HELD_IDS and i < len(times):
                    continue
                rows, repeats = batch.slice(start, i - start), times[start:i]
                told = [rows[c].flatten() for c in ("docs", "versions", "places")]
                sizes = np.repeat([len(v) for v in values], repeats)
                if counts:
                    told.append(pa.array(sizes.astype(np.int32)))
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    flat = np.concatenate([v if n == 1 else np.tile(v, n) for v, n in zip(values, repeats)])
                    told.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(told, ["doc", "version", "pos", value.split()[0]])
                start, values, held = i, [], 0

    cut = _cut(documents, doc, text, mean).repartition("key", "salt").sortWithinPartitions("key")
    return cut.select("key", "piece", "docs", "versions", "places").mapInArrow(run, f"doc {kind}, version bigint, pos int, {value}")


def _narrow(tokenizer: str, folder: str) -> bool:
    """Whether the tokenizer's ids fit into 16 bits."""
    return encoder(folder, tokenizer).n_vocab <= 1 << 16


def gather(found: DataFrame) -> DataFrame:
    """(doc, ids) of :func:`encoded_pieces`: the pieces of a document in order, repeated places once, as whole numbers."""
    narrow = found.schema["ids"].dataType.elementType.simpleString() == "smallint"
    by = found.groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("_p"), F.count_if(F.col("pos") == 0).alias("_n"))
    once = F.when(F.col("_n") == 1, F.col("_p")).otherwise(F.filter("_p", lambda p, i: i % F.col("_n") == 0))
    ids = F.flatten(F.transform(once, lambda p: p["ids"]))
    return by.select("doc", F.transform(ids, lambda x: x.cast("int") + 32768) if narrow else ids).toDF("doc", "ids")


def encode_corpus(documents: DataFrame, *, doc: str = "doc_id", **how: object) -> DataFrame:
    """(doc, ids): the token ids of every document's whole text, without special tokens.

    Null and empty texts give an empty array. Repeated rows of a document give one row; rows of one
    document with different texts give one row each. Whatever stands in a text, names of special tokens
    included, is ordinary text. Other columns are ignored; an empty table gives no rows.
    """
    return gather(encoded_pieces(documents, doc=doc, **how)).withColumnRenamed("doc", doc)


def token_counts(documents: DataFrame, *, doc: str = "doc_id", **how: object) -> DataFrame:
    """(doc, tokens): only the number of ids; no ids are shuffled. Repeated rows as in :func:`encode_corpus`."""
    found = encoded_pieces(documents, doc=doc, counts=True, **how)
    return found.groupBy("doc", "version").agg((F.sum("n") / F.count_if(F.col("pos") == 0)).cast("bigint").alias("tokens")).select(F.col("doc").alias(doc), "tokens")
