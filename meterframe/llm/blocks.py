"""Documents packed as token blocks, and exact counting of keys over blocks.

Operators that count word n-grams over the whole corpus would shuffle one row
for each token. Here a task packs about half a million tokens into one row: a table
of the block's distinct word hashes and the token stream as indexes into it,
ordered by frequency and compressed (about two bytes for each token).

Counting keys (``count_keys``) is a request and an answer. Each block sends the
sorted distinct keys it holds, cut into ranges of the key space, so a key takes
part once for each block however often it occurs: a word pair or a passage that
fills a third of the corpus weighs no more than a rare one. The task that owns a
range adds up the blocks' counts and sends each block one number for each key
it asked for, in the order of the request, so the answer carries no keys.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z and are held as 64-bit
hashes (xxh3).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TOKENS = 1 << 19
#: Keys that a counting task sorts at a time.
SLICE_KEYS = 1 << 19
#: Distinct words a task remembers the hash of, before it starts afresh.
CACHE_WORDS = 1 << 18

BLOCK_SCHEMA = ("block long, n_docs int, n_tokens long, doc_ids binary, doc_nulls binary, flags binary, tags binary, "
                "lengths binary, words binary, tokens binary")


def encode(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes; leading zero planes are left out."""
    a = np.ascontiguousarray(values, dtype="<u8")
    top = int(a.max()) if len(a) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def decode(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def encode_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences; the first one is kept whole."""
    if not len(keys):
        return encode(keys)
    return keys[0].astype("<u8").tobytes() + encode(np.diff(keys))


def decode_sorted(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    out[0] = np.frombuffer(blob[:8], dtype="<u8")[0]
    out[1:] = decode(blob[8:])
    return np.cumsum(out, dtype=np.uint64)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        h = h - (1 << 64) if h >> 63 else h
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


def word_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)


def split_words(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: exactly the words above."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def token_blocks(docs: DataFrame, flags: Column | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each block of documents; ``flags`` is a byte kept for each document,
    next to a hash of its text.

    Blocks are numbered by task, so the result must be staged before its
    numbers are used. A text longer than a block is a block of its own.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      (F.lit(0) if flags is None else flags).cast("int").alias("flags"),
                      F.xxhash64("text").alias("tag"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        cache, seq = WordHash(), 0
        ids, flag, tags, lengths, parts, held = [], [], [], [], [], 0
        for batch in batches:
            for doc_id, text, f, tag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(),
                                            batch.column(3).to_pylist()):
                h = word_hashes(split_words(text.as_py()), cache)
                ids.append(doc_id), flag.append(f or 0), tags.append(tag), lengths.append(len(h)), parts.append(h)
                held += len(h) + 1
                if held >= block_tokens:
                    yield block_row(first + (seq << 24), ids, flag, tags, lengths, parts)
                    ids, flag, tags, lengths, parts, held, seq = [], [], [], [], [], 0, seq + 1
        if ids:
            yield block_row(first + (seq << 24), ids, flag, tags, lengths, parts)

    return src.mapInArrow(pack, BLOCK_SCHEMA)


def block_row(block: int, ids, flags, tags, lengths, parts) -> pa.RecordBatch:
    all_tokens = np.concatenate(parts)
    words, index, n = np.unique(all_tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")  # frequent words get small numbers
    rank = np.empty(len(order), dtype=np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    row = {
        "block": [block], "n_docs": pa.array([len(ids)], pa.int32()), "n_tokens": [len(all_tokens)],
        "doc_ids": [np.array([i or 0 for i in ids], dtype="<i8").tobytes()],
        "doc_nulls": [np.array([i is None for i in ids], dtype=np.uint8).tobytes()],
        "flags": [np.array(flags, dtype=np.uint8).tobytes()], "tags": [np.array(tags, dtype="<i8").tobytes()],
        "lengths": [encode(np.array(lengths, dtype=np.uint64))],
        "words": [words[order].tobytes()], "tokens": [encode(rank[index])],
    }
    return pa.RecordBatch.from_pydict(row)


class Block:
    """A decoded block row."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.doc_ids = np.frombuffer(row["doc_ids"], dtype="<i8")
        self.doc_nulls = np.frombuffer(row["doc_nulls"], dtype=np.uint8).astype(bool)
        self.flags = np.frombuffer(row["flags"], dtype=np.uint8)
        self.tags = np.frombuffer(row["tags"], dtype="<i8")
        self.lengths = decode(row["lengths"]).astype(np.int64)
        self.words = np.frombuffer(row["words"], dtype="<u8")
        self.tokens = decode(row["tokens"]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def doc_id_array(self) -> pa.Array:
        return pa.array(self.doc_ids, pa.int64(), mask=self.doc_nulls)


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows one at a time, so that one decoded block is held, not a batch of them."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair (a, b), for hashes a and b."""
    h = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


#: What a block asks for: ascending distinct keys, and for each a row of counts (one column for each count).
Request = Callable[[Block], tuple[np.ndarray, np.ndarray]]


def count_keys(blocks: DataFrame, request: Request, n_counts: int, ranges: int, key_bits: int = 64,
               least: int = 0) -> DataFrame:
    """Answers to the blocks' requests: ``(block, part, n, counts, distinct, total)``.

    ``counts`` holds the corpus totals of the first count column for the keys
    of this range in request order, then those of the next; values below
    ``least`` are set to 0, so that what is rare costs nothing. ``distinct`` and
    ``total`` (keys of the range whose first count is above 0, and the sum of
    that count) stand on one of the range's rows. ``ranges`` follows the input:
    the caller derives it from the tokens counted.
    """
    shift = key_bits
    span = -(-(1 << key_bits) // ranges)

    def ask(batches):
        for batch in batches:
            for row in rows_of(batch):
                keys, counts = request(Block(row))
                cut = np.searchsorted(keys, np.array([min(p * span, (1 << shift) - 1) for p in range(1, ranges)],
                                                     dtype=np.uint64)) if ranges > 1 else []
                edges = [0, *map(int, cut), len(keys)]
                out = {"block": [], "part": [], "n": [], "keys": [], "counts": []}
                for p in range(ranges):
                    a, b = edges[p], edges[p + 1]
                    if a < b:
                        out["block"].append(row["block"]), out["part"].append(p), out["n"].append(b - a)
                        out["keys"].append(encode_sorted(keys[a:b]))
                        out["counts"].append(b"".join(len(e).to_bytes(4, "little") + e for e in
                                                      (encode(counts[a:b, c]) for c in range(n_counts))))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                    [("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()),
                     ("counts", pa.binary())]))

    def answer(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        n = group.column("n").to_pylist()
        keys = [decode_sorted(k.as_py(), m) for k, m in zip(group.column("keys"), n)]
        counts = [[narrow(c) for c in split_counts(v.as_py(), n_counts)] for v in group.column("counts")]
        head = group.select(["block", "part", "n"])
        del group
        # The range is added up in slices of the key space, one at a time; a block's
        # counts are overwritten by the sums.
        low, high = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys)
        slices = max(1, sum(n) // SLICE_KEYS)
        width = (high - low) // slices + 1
        distinct = total = 0
        at = [0] * len(n)
        for s in range(slices):
            top = min(low + (s + 1) * width - 1, high)
            ends = [int(np.searchsorted(k, np.uint64(top), side="right")) for k in keys]
            some = np.concatenate([k[a:b] for k, a, b in zip(keys, at, ends)])
            uniq, place = np.unique(some, return_inverse=True)
            for c in range(n_counts):
                sums = np.zeros(len(uniq), dtype=np.int64)
                np.add.at(sums, place, np.concatenate([v[c][a:b] for v, a, b in zip(counts, at, ends)]).astype(np.int64))
                if not c:
                    distinct, total = distinct + int((sums > 0).sum()), total + int(sums.sum())
                sums[sums < least] = 0
                full, done = narrow(sums)[place], 0
                for v, a, b in zip(counts, at, ends):
                    if v[c].itemsize < full.itemsize:
                        v[c] = v[c].astype(full.dtype)
                    v[c][a:b] = full[done:done + b - a]
                    done += b - a
            at = ends
        del keys
        out = []
        for i, v in enumerate(counts):
            out.append(b"".join(len(e).to_bytes(4, "little") + e for e in map(encode, v)))
            counts[i] = None
        rest = [0] * (len(n) - 1)
        return (head.append_column("counts", pa.array(out, pa.binary()))
                .append_column("distinct", pa.array([distinct, *rest], pa.int64()))
                .append_column("total", pa.array([total, *rest], pa.int64())))

    asked = blocks.mapInArrow(ask, "block long, part int, n long, keys binary, counts binary")
    return asked.groupBy("part").applyInArrow(
        answer, "block long, part int, n long, counts binary, distinct long, total long")


def narrow(values: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return values.astype(np.int32) if not len(values) or int(values.max()) < 1 << 31 else values


def split_counts(blob: bytes, n_counts: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(n_counts):
        size = int.from_bytes(blob[at:at + 4], "little")
        out.append(decode(blob[at + 4:at + 4 + size]).astype(np.int64))
        at += 4 + size
    return out


def answered(table: pa.Table, n_counts: int) -> np.ndarray:
    """A block's answers in the order of its request, one column for each count."""
    if not table.num_rows:
        return np.zeros((0, n_counts), dtype=np.int64)
    table = table.sort_by("part")
    return np.concatenate([np.stack(split_counts(c.as_py(), n_counts), axis=1) for c in table.column("counts")])
