"""Problem 7: token ids of a whole corpus, passages shared by texts encoded once.

1. Equal texts become one row (the copies are counted on the map side).
2. A rolling hash over 24 characters cuts each text into chunks of about 256 characters,
   at places that depend on the content alone, so that shared passages give equal chunks.
   Only place, length and digest of a chunk are written, never its characters.
3. Each chunk that stands in several places is encoded once, where it stands first, between
   its first and its last *agreed* place.
4. Every text takes the ids of its shared chunks and encodes what lies between: from the
   last agreed place before a join to the first agreed place behind it, over as many chunks
   as that takes. A text without shared chunks is encoded in one piece.

A place is agreed if a single space stands there between two printable ASCII characters:
no match of the vocabulary's splitting pattern can reach across it, whatever text lies
around, so encodings on both sides are exact. Chunks without such a place are wholly
encoded again within their text.

Defined results: null, empty -> empty list; blank text -> the ids of the blanks; repeated
texts and rows -> the same ids in each row; an empty table -> no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import hot_keys, join_to_unique
from millrace.session import checkpointed, spread

VOCAB_DIR = "/opt/tokenizers"
VOCAB = "byte_bpe_50k.tiktoken"
#: How a text is split before merging; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW, CUT_BITS, LONGEST = 24, 8, 2048
_AGREED = re.compile(r"(?<=[!-~]) (?=[!-~])")
_ODD, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a rank file; loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(vocab_dir: str = VOCAB_DIR, name: str = VOCAB) -> str:
    return os.path.join(vocab_dir, name)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the texts, places of all texts joined where the hash of the window before asks for a cut)."""
    ends = np.cumsum([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(_MIX)
    n = len(code)
    if n <= WINDOW:
        return ends, np.zeros(0, np.int64)
    code ^= code >> np.uint64(29)
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    code *= down[:n]
    total = np.cumsum(code, out=code)
    window = total[WINDOW - 1 :].copy()
    window[1:] -= total[:-WINDOW]
    window *= up[WINDOW - 1 : n]
    return ends, np.flatnonzero(window >> np.uint64(64 - CUT_BITS) == 0) + WINDOW


def cuts_of(texts: list[str]) -> list[list[int]]:
    """Starts of the chunks of each text: 0, and the places the content chooses."""
    ends, found = _hashes(texts)
    begins = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else ends
    # A place counts only if its window lies within the text.
    low, high = np.searchsorted(found, begins + WINDOW), np.searchsorted(found, ends)
    places, out = found.tolist(), []
    for k, text in enumerate(texts):
        begin, own = int(begins[k]), [0]
        for at in [*[p - begin for p in places[low[k] : high[k]]], len(text)]:
            while at - own[-1] > LONGEST:
                own.append(own[-1] + LONGEST)
            if own[-1] < at < len(text):
                own.append(at)
        out.append(own)
    return out


def cuts(text: str) -> list[int]:
    return cuts_of([text])[0]


def _slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of together about ``most`` characters, at least one text each."""
    a, size = 0, 0
    for b, text in enumerate(texts):
        if b > a and size + len(text) > most:
            yield a, b
            a, size = b, 0
        size += len(text)
    if texts:
        yield a, len(texts)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = hashlib.md5
    for batch in batches:
        texts, keys = batch.column(1).to_pylist(), batch.column(0)
        for a, b in _slices(texts, 1 << 18):
            owner, starts, sizes, chunks = [], [], [], []
            for k, at in enumerate(cuts_of(texts[a:b]), a):
                if len(at) == 1 and len(texts[k]) < WINDOW:
                    continue  # too short to share a chunk
                text = texts[k]
                for begin, end in zip(at, [*at[1:], len(text)]):
                    owner.append(k)
                    starts.append(begin)
                    sizes.append(end - begin)
                    chunks.append(digest(text[begin:end].encode("utf-8", "surrogatepass")).digest())
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(owner, pa.int64())), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(chunks, pa.binary())], ["text_key", "start", "size", "chunk_key"]
            )


def agreed(chunk: str) -> tuple[int, int]:
    """The first and last agreed place of a chunk, or -1, -1."""
    first = _AGREED.search(chunk)
    if first is None:
        return -1, -1
    return first.start(), len(chunk) - 1 - _AGREED.search(chunk[::-1]).start()


def _middles(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary  # its batch form costs a thread's hand-over per text
        for batch in batches:
            keys, firsts, lasts, ids = [], [], [], []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in own:
                    chunk = text[part["start"] : part["start"] + part["size"]]
                    a, b = agreed(chunk)
                    keys.append(part["chunk_key"])
                    firsts.append(a)
                    lasts.append(b)
                    ids.append(encode(chunk[a:b]) if a >= 0 else [])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["chunk_key", "first", "last", "middle"])

    return run


def _joined(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            out = []
            for text, parts in zip(batch.column("_text").to_pylist(), batch.column("parts")):
                if not parts.is_valid:
                    out.append(encode(text))
                    continue
                inner = parts.values
                start, first, last = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                middle, ids, begin = inner.field(3), [], 0
                for c in np.argsort(start, kind="stable"):
                    if first[c] >= 0:
                        ids += encode(text[begin : start[c] + first[c]])
                        ids += middle[int(c)].as_py()
                        begin = start[c] + last[c]
                out.append(ids + encode(text[begin:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """(id_col, ids): the token ids of every text; chunks that texts share are encoded once.

    Ids travel only for texts that stand in several rows; null and empty texts never meet
    the joins. Hot texts and hot chunks are salted; nothing of the corpus reaches the driver.
    """
    path = vocab or vocabulary()
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    empty = docs.where("_text IS NULL OR _text = ''").select(F.col("_id").alias(id_col), F.array().cast("array<int>").alias("ids"))
    keyed = docs.where("_text <> ''").withColumn("text_key", F.unhex(F.md5("_text")))
    texts = keyed.groupBy("text_key").agg(F.first("_text").alias("_text"), F.min("_id").alias("_id"), F.count("*").alias("_n"))
    # Cut where the rows are; copies of a text give the same places, which the grouping drops.
    chunks = checkpointed(spread(keyed.select("text_key", "_text")).mapInArrow(_chunks, "text_key binary, start int, size int, chunk_key binary").distinct())
    place = F.struct("text_key", "start", "size")
    shared = chunks.groupBy("chunk_key").agg(F.min(place).alias("own"), F.count("*").alias("_n")).where("_n > 1")
    shared = checkpointed(shared.select("chunk_key", "own.*", "_n"))
    owned = shared.groupBy("text_key").agg(F.collect_list(F.struct("chunk_key", "start", "size")).alias("own"))
    # Each use of the texts reads the same columns, so that they are shuffled once.
    middles = texts.join(owned, "text_key").select("_text", "own", "_id", "_n").mapInArrow(_middles(path), "chunk_key binary, first int, last int, middle array<int>")
    parts = join_to_unique(chunks.select("text_key", "start", "chunk_key"), middles, "chunk_key", hot_keys(shared, "chunk_key", "_n"), F.xxhash64("text_key", "start"), "inner")
    parts = parts.groupBy("text_key").agg(F.collect_list(F.struct("start", "first", "last", "middle")).alias("parts"))
    rows = texts.join(parts, "text_key", "left")
    once = rows.where("_n = 1").select(F.col("_id").alias("key"), "_text", "parts", "_n").mapInArrow(_joined(path), f"key {docs.schema['_id'].dataType.simpleString()}, ids array<int>")
    once = once.withColumnRenamed("key", id_col)
    several = rows.where("_n > 1").select(F.col("text_key").alias("key"), "_text", "parts", "_id", "_n").mapInArrow(_joined(path), "key binary, ids array<int>").withColumnRenamed("key", "text_key")
    counts = keyed.groupBy("text_key").agg(F.count("*").alias("_n"))
    again = join_to_unique(keyed.select("_id", "text_key"), several, "text_key", hot_keys(counts, "text_key", "_n"), F.xxhash64("_id"), "inner")
    return once.unionByName(again.select(F.col("_id").alias(id_col), "ids")).unionByName(empty)


def token_counts(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", vocab: str | None = None) -> DataFrame:
    """``docs`` with the number of tokens of each text; 0 for null and empty text."""
    path = vocab or vocabulary()

    @F.pandas_udf("int")
    def count(texts):
        encode = encoding(path).encode_ordinary
        return texts.__class__([len(encode(x)) if x else 0 for x in texts], dtype="int32")

    return docs.withColumn(out_col, count(F.col(text_col)))
