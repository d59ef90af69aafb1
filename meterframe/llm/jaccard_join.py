"""N-gram Jaccard join: which documents reach each other by links.

Two documents link when the Jaccard similarity of their sets of word n-grams is
at least ``num / den``. Sets are 64-bit hashes of n-grams, sorted.

1. Every n-gram's document frequency is counted over token blocks (by a
   shortened hash, which can only raise a count). Under the order (frequency,
   hash), two sets that link share one of their first ``n - ceil(t * n) + 1``
   members, and one that no other document has cannot be it: only documents
   with a prefix member of frequency 2 or more go on. Equal sets are one class.
2. Tiles: classes that share a prefix member and lie in the same band of sizes
   (bands grow by 1 / t, so linked sizes are at most one band apart; each class also
   visits the next band's tile). No tile is paired among itself at first: each
   class is held against the tile's smallest one, and links give components.
3. Tiles that still hold several components are cut into blocks of at most
   ``TILE_ROWS`` classes, block against block. A pair is looked at in one tile
   only, that of its first shared prefix member: each row carries the members
   that come before the tile's, and the place of that member bounds the overlap.
   Two passes test only a spanning forest of a block's components (the most
   alike first), a last one all that is left. Each class has a hashed bitmap
   of its set, a bit being the parity of the members that fall on it, of one to
   four bits a member: ``|A ^ B| >= popcount(a ^ b)``, so bit counts bound the
   overlap from above. Pairs of different components that the bounds leave
   are intersected exactly, as sorted arrays.

Pairs inside a component are not looked at again: they cannot change the
result. A group of near copies costs one comparison a member, and no pair of
different components that could link goes untested.

Defined results: null, empty or blank texts have no n-grams and link with
nothing; a text of fewer than n words is one n-gram; repeated rows are
documents of their own; null ids are passed over as names of components, a
component without any other has none; an empty table gives no rows. Only doc_id
and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.blocks import Block, answered, count_keys, mix, rows_of, token_blocks
from meterframe.llm.common import discard, stage
from meterframe.llm.components import components, join_components

#: Bits of the smallest bitmap; larger sets have the power of two at or above twice their size.
LEAST_BITS = 256
TILE_ROWS = 1024
#: Bits of the hash by which frequencies are counted.
KEY_BITS = 44
#: N-grams for each range of the key space, that is for each counting task.
RANGE_KEYS = 4_000_000


def ngram_sets(b: Block, n: int) -> list[np.ndarray]:
    """Each document's distinct n-grams, ascending."""
    w = b.words[b.tokens]
    out, at = [], 0
    gram = w.copy()
    for k in range(1, n):
        if len(w) > k:
            gram[:-k] = mix(gram[:-k], w[k:])
    for m in b.lengths.tolist():
        if m >= n:
            out.append(np.unique(gram[at:at + m - n + 1]))
        elif m:
            whole = np.array([m], dtype=np.uint64)
            for i in range(at, at + m):
                whole = mix(whole, w[i:i + 1])
            out.append(whole)
        else:
            out.append(w[:0])
        at += m
    return out


def _short(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - KEY_BITS)


def _signature(keys: np.ndarray) -> bytes:
    size = max(LEAST_BITS, 1 << (2 * len(keys) - 1).bit_length())
    bits = np.bincount((keys & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _folded(signature: bytes, size: int) -> np.ndarray:
    """The bitmap of ``size`` bytes for the same set: parities of bits that fall together."""
    return np.bitwise_xor.reduce(np.frombuffer(signature, dtype=np.uint8).reshape(-1, size), axis=0)


def least_overlap(total: int, num: int, den: int) -> int:
    """Smallest intersection of linked sets whose sizes add up to ``total``."""
    return -(-num * total // (num + den))


def document_sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(uid, doc_id, tag, n_shingles) of all documents, and of those that may link: set_key, keys, signature, prefix, alone.

    ``prefix`` holds the prefix members that other documents have, in the common
    order; the ``alone`` members of the set that no other document has come before them.
    """
    blocks, blocks_at = stage(token_blocks(docs), "shingle-blocks")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0

    def request(b: Block):
        sets = ngram_sets(b, n)
        keys, counts = np.unique(_short(np.concatenate(sets)) if sets else np.zeros(0, np.uint64), return_counts=True)
        return keys, counts[:, None]

    answers, answers_at = stage(
        count_keys(blocks, request, 1, max(1, -(-tokens // RANGE_KEYS)), KEY_BITS, least=2).select("block", "part", "counts"),
        "shingle-counts")
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n_shingles", pa.int64()),
                        ("set_key", pa.binary()), ("keys", pa.binary()), ("signature", pa.binary()),
                        ("prefix", pa.list_(pa.int64())), ("alone", pa.int64())])

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left.slice(0, 1).to_pylist()[0])
        df = answered(right, 1)[:, 0]
        sets = ngram_sets(b, n)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        seen = df[np.unique(_short(flat), return_inverse=True)[1]] if len(flat) else df
        cols = {f.name: [] for f in schema}
        at = 0
        for i, s in enumerate(sets):
            m = len(s)
            d = seen[at:at + m]
            at += m
            prefix = None
            if m:
                short = m - (-(-num * m // den)) + 1
                first = np.lexsort((s, d))[:short]
                shared = first[d[first] >= 2]
                prefix = s[shared].view(np.int64).tolist() if len(shared) else None
            cols["uid"].append(b.block + i), cols["n_shingles"].append(m), cols["prefix"].append(prefix)
            cols["alone"].append(int((d < 2).sum()))
            raw = s.tobytes() if prefix else None
            cols["set_key"].append(xxhash.xxh3_128_digest(raw) if prefix else None)
            cols["keys"].append(raw), cols["signature"].append(_signature(s) if prefix else None)
        cols["doc_id"], cols["tag"] = b.doc_id_array(), b.tags
        return pa.table(cols, schema=schema)

    out, _ = stage(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        candidates, "uid long, doc_id long, tag long, n_shingles long, set_key binary, keys binary, signature binary, "
                    "prefix array<long>, alone long"), "shingle-sets")
    discard(docs.sparkSession, blocks_at, answers_at)
    return out


def exact_links(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link."""
    side = lambda x: classes.select(F.col("uid").alias(x), F.col("keys").alias(f"keys_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("keys_a"), batch.column("keys_b")):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                total = len(x) + len(y)
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= least_overlap(total, num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "keys_a", "keys_b").mapInArrow(check, "a long, b long")


def tile_pairs(rows: dict, num: int, den: int, forest: bool) -> np.ndarray:
    """Pairs of one tile that sizes, places and bit counts leave: different components, one at home, not yet
    tested, and no shared prefix member before the tile's.

    With ``forest`` only those of a spanning forest of the components, the most
    alike first: fewer than the tile has rows.
    """
    least = min(map(len, rows["signature"]))
    sig = np.stack([_folded(x, least) for x in rows["signature"]]).view("<u8")
    uid, size, comp, home, side, first, place = (
        np.array(rows[c]) for c in ("uid", "n_shingles", "comp", "home", "side", "first", "place"))
    rest = size - place  # members from the tile's on: all that a pair first met here can share
    sets: dict = {}

    def before(i):
        if i not in sets:
            sets[i] = set(rows["before"][i].tolist())
        return sets[i]
    left, right, room = [], [], []
    for i in range(len(uid)):
        if uid[i] == first[i]:
            continue
        other = np.flatnonzero((comp != comp[i]) & (uid > uid[i]) & (home | home[i]) & (uid != first) &
                               ((side != side[i]) | (side == 2)))
        total = size[other] + size[i]
        need = -(-num * total // (num + den))
        ok = np.minimum(rest[other], rest[i]) >= need
        other, total, need = other[ok], total[ok], need[ok]
        if not len(other):
            continue
        bits = np.bitwise_count(sig[other] ^ sig[i]).sum(axis=1).astype(np.int64)
        most = np.minimum((total - bits) // 2, np.minimum(rest[other], rest[i]))
        ok = np.flatnonzero(most >= need)
        ok = ok[[before(i).isdisjoint(before(j)) for j in other[ok].tolist()]] if len(ok) else ok
        left.append(np.full(len(ok), i)), right.append(other[ok]), room.append((most - need)[ok])
    if not left:
        return np.zeros((0, 2), dtype=np.int64)
    left, right, room = np.concatenate(left), np.concatenate(right), np.concatenate(room)
    if forest:
        root: dict = {}
        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x
        keep = []
        for e in np.argsort(-room, kind="stable"):
            a, b = find(comp[left[e]]), find(comp[right[e]])
            if a != b:
                root[max(a, b)] = min(a, b)
                keep.append(e)
        left, right = left[keep], right[keep]
    return np.stack([uid[left], uid[right]], axis=1)


def _tiles_to_pairs(placed: DataFrame, found: DataFrame, classes: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Pairs to test in tiles that hold several components (``found``: node, component)."""
    known = placed.join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("component", "uid"))
    known, _ = stage(known.drop("component"), "tiles-known")
    mixed = known.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(
        F.col("lo") != F.col("hi")).select("token", "band")
    blocks = F.ceil(F.col("rows") / TILE_ROWS).cast("int")
    mine = F.pmod(F.xxhash64("uid"), blocks).cast("int")
    # A block meets itself and each other block of its tile once; side tells which
    # of the two a row is from (2: the block meets itself).
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(
        F.least(i, F.col("mine")).alias("one"), F.greatest(i, F.col("mine")).alias("two"),
        F.when(i == F.col("mine"), 2).when(F.col("mine") < i, 0).otherwise(1).alias("side")))
    todo = (known.join(mixed, ["token", "band"]).withColumn("mine", mine).withColumn("meet", F.explode(meets))
            .select("token", "band", "meet.one", "meet.two", "meet.side", "uid", "n_shingles", "comp", "home", "first", "at")
            .join(classes.select("uid", "signature", "prefix", "alone"), "uid")
            .withColumn("place", F.col("alone") + F.col("at")).withColumn("before", F.slice("prefix", F.lit(1), F.col("at")))
            .drop("prefix", "alone", "at"))
    keys = ["token", "band", "one", "two"]

    def compare(batches):
        held: dict = {}
        names = ["uid", "n_shingles", "comp", "home", "first", "side", "place", "signature", "before"]

        def flush():
            pairs = tile_pairs(held, num, den, forest)
            return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})
        now = None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in [*keys, *names[:-1]]}
            lists = batch.column("before")
            ends, members = lists.offsets.to_numpy(), lists.values.to_numpy()
            cols["before"] = [members[x:y] for x, y in zip(ends[:-1], ends[1:])]
            for r, key in enumerate(zip(*(cols[k] for k in keys))):
                if key != now:
                    if now is not None:
                        yield flush()
                    now, held = key, {c: [] for c in names}
                for c in names:
                    held[c].append(cols[c][r])
        if now is not None:
            yield flush()

    return todo.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct()


def link_components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(uid, doc_id, tag, n_shingles, component_id, component) for each row of ``docs``.

    ``component`` numbers the component itself; it is null for rows that cannot link.
    """
    if not (n >= 1 and 0 < num <= den):
        raise ValueError("n must be positive and the similarity above 0 and at most 1")
    sets = document_sets(docs, n, num, den)
    may = sets.where(F.col("set_key").isNotNull())
    classes_of = may.groupBy("set_key").agg(F.min("uid").alias("class"))
    member = may.select("uid", "doc_id", "set_key").join(classes_of, "set_key").select("uid", "doc_id", "class")
    member, _ = stage(member, "set-members")
    classes = may.join(member.where(F.col("uid") == F.col("class")).select("uid"), "uid", "left_semi")
    classes, _ = stage(classes.select("uid", "n_shingles", "keys", "signature", "prefix", "alone"), "set-classes")

    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(den / num) + 1e-9).cast("int") if num < den else F.col("n_shingles").cast("int")
    places = classes.select("uid", "n_shingles", F.posexplode("prefix").alias("at", "token"), band.alias("own"))
    visits = F.array(F.struct(F.col("own").alias("band"), F.lit(True).alias("home")),
                     F.struct((F.col("own") + 1).alias("band"), F.lit(False).alias("home")))
    slim = places.select("uid", "n_shingles", "at", "token", F.explode(visits).alias("x")).select(
        "uid", "n_shingles", "at", "token", F.col("x.band").alias("band"), F.col("x.home").alias("home"))
    tiles = slim.groupBy("token", "band").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("home"), F.col("uid"))).alias("first")).where(
        (F.col("rows") > 1) & F.col("first").isNotNull())
    placed, _ = stage(slim.join(tiles, ["token", "band"]), "tiles")
    stars = (placed.where(F.col("uid") != F.col("first"))
             .select(F.least("uid", "first").alias("a"), F.greatest("uid", "first").alias("b")).distinct())
    links, _ = stage(exact_links(stars, classes, num, den), "star-links")
    found = components(links)

    # Spanning forests first (linear), so that only components that seem apart
    # are left for the pass that tests whatever remains.
    for forest in (True, True, False):
        more, _ = stage(exact_links(_tiles_to_pairs(placed, found, classes, num, den, forest), classes, num, den), "tile-links")
        found = join_components(found, more)
    named = member.join(found.select(F.col("node").alias("class"), "component"), "class", "left")
    named = named.withColumn("comp", F.coalesce("component", "class"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("least_id"))
    names = named.join(least, "comp").select("uid", "least_id", F.col("comp").alias("component"))
    return (sets.select("uid", "doc_id", "tag", "n_shingles").join(names, "uid", "left")
            .select("uid", "doc_id", "tag", "n_shingles",
                    F.when(F.col("component").isNotNull(), F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    "component"))
