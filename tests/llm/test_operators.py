"""The operators against brute force, and on odd input: nulls, empty and repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterframe.llm import (ann, blocks, components, decontamination, jaccard_join, line_dedup, lm_scoring, mixing, pii,
                            sharding, toxicity, viterbi_counts)

ODD = "doc_id long, text string, lang string, source string, uid long, term long, pos int, no_id string, key string, budget long"


def odd_docs(spark, texts=None):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (2, ""), (3, None), (None, "x y z"), (None, None),
            (4, "   \n\t "), (5, long), (6, long + " end"), (7, "A b C d e f g h i j k"), *(texts or [])]
    return spark.createDataFrame([(i, t, None, "s1", 1, 2, 3, "n", "k", 9) for i, t in rows], ODD)


def empty_docs(spark):
    return spark.createDataFrame([], ODD)


def words(text):
    return (text or "").encode().lower().split()


def test_blocks_round_trip_and_counts(spark):
    rng = np.random.default_rng(0)
    for a in (np.zeros(0, np.uint64), rng.integers(0, 1 << 63, 1000).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)):
        assert (blocks.decode(blocks.encode(a)) == a).all()
        s = np.unique(a)
        assert (blocks.decode_sorted(blocks.encode_sorted(s), len(s)) == s).all()
    docs = odd_docs(spark)
    packed = blocks.token_blocks(docs, block_tokens=10).collect()
    seen = [blocks.Block(r.asDict()) for r in packed]
    assert sum(len(b) for b in seen) == docs.count()
    assert sum(int(b.lengths.sum()) for b in seen) == sum(len(words(r.text)) for r in docs.collect())


def brute_components(texts, n, num, den):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (2, 1, 2), (3, 1, 1)])
def test_jaccard_components(spark, n, num, den):
    rng = np.random.default_rng(n)
    texts, i = {}, 0
    for _ in range(12):  # groups of near copies in chains, so that members are linked only through others
        base = [f"v{x}" for x in rng.integers(0, 400, 60)]
        for _ in range(int(rng.integers(1, 12))):
            base = list(base)
            for _ in range(int(rng.integers(0, 3))):
                base[int(rng.integers(0, len(base)))] = f"q{rng.integers(0, 10**6)}"
            texts[i], i = " ".join(base), i + 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_join.link_components(docs, n, num, den).collect()}
    want, sizes = brute_components(texts, n, num, den)
    assert got == {x: (want[x], sizes[x]) for x in texts}


def test_jaccard_tiles_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 3)
    test_jaccard_components(spark, 4, 85, 100)


def test_bitmaps_bound_the_overlap_at_every_size():
    rng = np.random.default_rng(3)
    for size in (1, 5, 300, 6000):
        both = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for apart in (0, 1, size):
            a, b = (np.r_[both, rng.integers(0, 1 << 63, apart).astype(np.uint64)] for _ in "ab")
            a, b = jaccard_join._signature(a), jaccard_join._signature(b)
            for least in {32, len(a), len(b)}:
                if least <= min(len(a), len(b)):
                    x, y = jaccard_join._folded(a, least), jaccard_join._folded(b, least)
                    assert np.bitwise_count(x ^ y).sum() <= 2 * apart
    a, b = (jaccard_join._signature(rng.integers(0, 1 << 63, 6000).astype(np.uint64)) for _ in "ab")
    assert np.bitwise_count(jaccard_join._folded(a, len(a)) ^ jaccard_join._folded(b, len(a))).sum() > 4000


def test_a_pair_is_looked_at_in_one_tile():
    common = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    def tile(at, shared):
        before = common[:at].view(np.int64)
        return {"uid": [1, 2, 3], "n_shingles": [100] * 3, "comp": [1, 2, 3], "home": [True] * 3, "side": [2] * 3,
                "first": [1] * 3, "place": [at] * 3, "signature": [jaccard_join._signature(common)] * 3,
                "before": [before, before, before if shared else before + 1]}
    assert jaccard_join.tile_pairs(tile(0, True), 85, 100, False).tolist() == [[2, 3]]
    assert jaccard_join.tile_pairs(tile(5, True), 85, 100, False).tolist() == []
    assert jaccard_join.tile_pairs(tile(5, False), 85, 100, False).tolist() == [[2, 3]]
    assert jaccard_join.tile_pairs(tile(9, False), 85, 100, False).tolist() == []  # 91 members left, 92 needed


def test_jaccard_odd(spark):
    got = jaccard_join.link_components(odd_docs(spark), 4, 85, 100).collect()
    by = collections.Counter((r.doc_id, r.component_id, r.n_shingles) for r in got)
    assert by[(1, 1, 8)] == 2 and by[(7, 1, 8)] == 1 and by[(6, 5, 19998)] == 1
    assert by[(2, 2, 0)] == by[(3, 3, 0)] == by[(4, 4, 0)] == 1 and by[(None, None, 1)] == by[(None, None, 0)] == 1
    assert jaccard_join.link_components(empty_docs(spark), 4, 85, 100).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_joined_by_later_links(spark):
    found = components.components(spark.createDataFrame([(1, 2), (2, 3), (5, 6), (8, 9)], "a long, b long"))
    links = spark.createDataFrame([(3, 6), (6, 7), (20, 21), (3, 1)], "a long, b long")
    got = {r.node: r.component for r in components.join_components(found, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8, 20: 20, 21: 20}
    none = links.where("a < 0")
    assert components.join_components(found, none).count() == found.count()
    assert components.join_components(components.components(none), links).count() == 6


def test_lm_base_and_model(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.4, 80) % 200)) for i in range(150)]
    df = odd_docs(spark, docs)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    train = [w for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for w in [*words(t), None]]
    c, n = collections.Counter(train), len(train)
    want = sorted(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in [*words(t), None]) for _, t in rows)
    for order in (1, 2, 3):
        got = lm_scoring.score_documents(df, order=order, iterations=5).collect()
        assert np.allclose(sorted(r.base_score for r in got), want)
        assert {r.train_tokens for r in got} == {n}
        assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)
        kept = [r for r in got if r.doc_id is not None and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)]
        assert len(kept) == len([1 for i, _ in rows if i is not None])
    assert lm_scoring.score_documents(empty_docs(spark)).count() == 0


class PlainLM:
    """Deleted interpolation in plain Python: a probability for each (history, token), weights by EM on the deleted documents."""

    def __init__(self, rows, order, iterations):
        self.order, self.c = order, [collections.Counter() for _ in range(order)]
        kept = [collections.Counter() for _ in range(order)]
        self.docs = kept_docs = 0
        events = []
        for i, t in rows:
            crc = zlib.crc32(str("" if i is None else i).encode())
            if crc % 7 == 2:
                continue
            self.docs += 1
            deleted = crc // 7 % 10 == 0
            kept_docs += not deleted
            for history, w in self.tokens(t):
                for k in range(order):
                    gram = (*history[len(history) - k:], w)
                    self.c[k][gram] += 1
                    kept[k][gram] += not deleted
                if deleted:
                    events.append((history, w))
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])
        self.weights, self.u = collections.defaultdict(lambda: 0.5), 0.5
        n_kept, flat = sum(kept[0].values()), 1 / (sum(x > 0 for x in kept[0].values()) + 1)
        for _ in range(iterations if events else 0):
            own, rest, uniform, all_ = collections.Counter(), collections.Counter(), 0.0, 0.0
            for history, w in events:
                ml = [kept[0][(w,)] / max(n_kept, 1)] + [self.ml(kept, kept_docs, history, w, k)[0] for k in range(1, order)]
                bucket = [self.ml(kept, kept_docs, history, w, k)[1] for k in range(1, order)]
                mixed = [(1 - self.u) * ml[0] + self.u * flat]
                for k in range(1, order):
                    x = self.weight(k, bucket[k - 1])
                    mixed.append(x * ml[k] + (1 - x) * mixed[-1])
                here = 1.0  # chance that the token came from this order or below
                for k in range(order - 1, 0, -1):
                    x = self.weight(k, bucket[k - 1])
                    own[k, bucket[k - 1]] += here * x * ml[k] / mixed[k]
                    here *= (1 - x) * mixed[k - 1] / mixed[k]
                    rest[k, bucket[k - 1]] += here
                uniform += here * self.u * flat / mixed[0]
                all_ += here
            self.u = min(max(uniform / all_, 1e-6), 1.0)
            for key in own:
                if key[1] and own[key] + rest[key] > 0:
                    self.weights[key] = min(own[key] / (own[key] + rest[key]), 1 - 1e-6)

    def tokens(self, text):
        all_ = ["<s>"] * (self.order - 1) + [*words(text), "</s>"]
        return [(tuple(all_[:i]), all_[i]) for i in range(self.order - 1, len(all_))]

    def ml(self, counts, docs, history, w, k):
        context = history[len(history) - k:]
        seen = docs if context[-1] == "<s>" else counts[k - 1][context]
        gram = (*context, w)
        return (counts[k][gram] / seen if seen else 0.0), (seen.bit_length() if seen else 0)

    def weight(self, k, bucket):
        return self.weights[k, bucket] if bucket else 0.0

    def p(self, history, w):
        p = (1 - self.u) * self.c[0][(w,)] / max(self.n, 1) + self.u / (self.v + 1)
        for k in range(1, self.order):
            ml, bucket = self.ml(self.c, self.docs, history, w, k)
            x = self.weight(k, bucket)
            p = x * ml + (1 - x) * p
        return p


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_against_a_plain_model(spark, order):
    rng = np.random.default_rng(order)
    docs = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.5, int(rng.integers(0, 40))) % 60)) for i in range(200)]
    docs += [(None, "t1 t2 t1"), (7, None), (8, ""), (9, "never seen words"), (9, "never seen words")]
    plain = PlainLM(docs, order, 6)
    want = collections.defaultdict(list)
    for i, t in docs:
        want[i].append(sum(math.log10(plain.p(h, w)) for h, w in plain.tokens(t)))
    got = collections.defaultdict(list)
    for r in lm_scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), order=order, iterations=6).collect():
        got[r.doc_id].append(r.score)
    assert set(got) == set(want)
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-9, atol=1e-9), i
    # Over the known words, the end and one unknown symbol, each history's probabilities add up to one.
    histories = {h for _, t in docs[:40] for h, _ in plain.tokens(t)}
    for h in histories:
        assert abs(sum(plain.p(h, w) for (w,) in plain.c[0]) + plain.p(h, object()) - 1) < 1e-9


def test_viterbi_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rng = np.random.default_rng(1)
    pieces = {"▁": -3.0, "▁▁": -4.0}
    for _ in range(300):
        p = "".join(rng.choice(list("abcde"), int(rng.integers(1, 5))))
        pieces[("▁" if rng.random() < 0.4 else "") + p] = -float(rng.integers(1, 9))
    vocab = sorted(pieces.items())
    model = tokenizers.models.Unigram([("<unk>", 0.0), *vocab], 0, False)
    low = min(s for _, s in vocab)
    counter = viterbi_counts.Counter(viterbi_counts.Vocabulary(tuple(vocab), False))
    assert counter.by_word
    for _ in range(400):
        text = "".join(rng.choice(list("abcdefé  \n"), int(rng.integers(1, 40))))
        marked = "▁" + text.replace(" ", "▁")
        whole = counter.search(marked)
        if low <= 0:
            assert counter.count(text)[0] == whole[0]
            tokens = model.tokenize(marked)
            assert whole[1] == len(tokens), (text, whole, [t.value for t in tokens])
            if not re.search("[^abcde ]", text):
                assert counter.count(text) == whole
    got = viterbi_counts.count_tokens(odd_docs(spark), viterbi_counts.Vocabulary(tuple(vocab), True)).collect()
    assert len(got) == 10 and all(r.n_tokens == 0 for r in got if r.doc_id in (2, 3))
    assert viterbi_counts.count_tokens(empty_docs(spark), viterbi_counts.Vocabulary((), True)).count() == 0


def brute_shard(key, n):
    def score(i):
        x = int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16)
        return -1 / math.log((x + 0.5) / 2**52)
    return max(range(n), key=lambda i: (score(i), -i))


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 4)
    df = odd_docs(spark, [(i, f"text {i}") for i in range(100, 400)] + [(11, "é")] * 30)
    got = sharding.shard_documents(df, [1.0] * 5).collect()
    assert len(got) == df.count()
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (brute_shard(key, 5), brute_shard(key, 6)) and r.grown_shard in (r.shard, 5)
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in [(r.doc_id, r.text) for r in df.collect()])
    assert sorted((r.size, r.text_crc32) for r in got) == want
    heavy = sharding.shard_documents(df, [3.0, 1.0]).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in heavy}[0] > 180
    assert sharding.shard_documents(empty_docs(spark), [1.0]).count() == 0


def test_mixing_redistributes_among_siblings_first(spark):
    rows = [(i, "w " * 10, "en", s, d) for i, (d, s) in enumerate(
        [("big", "a")] * 4 + [("big", "b")] * 60 + [("small", "c")] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    mix = mixing.Mix(("domain", "lang", "source"), {("big",): 1, ("small",): 1}, share=0.5, max_epochs=1)
    got = mixing.choose(df, mix).groupBy("source").agg(F.sum("take_tokens").alias("t")).collect()
    # 570 tokens: 285 each; source a can give 40 of its 143, b takes the other 245 before the other domain does.
    assert {r.source: r.t for r in got} == {"a": 40, "b": 245, "c": 285}
    twice = mixing.choose(df, mixing.Mix(mix.levels, {("big",): 9, ("small",): 1, ("big", "en", "a"): 3}, share=0.5, max_epochs=2))
    got = {r.source: r.t for r in twice.groupBy("source").agg(F.sum("take_tokens").alias("t")).collect()}
    assert got == {"a": 80, "b": 433, "c": 57}
    assert twice.where("source = 'a'").groupBy("doc_id").count().where("count <> 2").count() == 0


def test_mixing_odd(spark):
    df = odd_docs(spark).withColumn("domain", F.lit(None).cast("string"))
    mix = mixing.Mix(("domain", "lang", "source"), {}, share=0.5, max_epochs=1)
    got = mixing.choose(df, mix)
    assert got.columns == [*df.columns, "epoch", "n_tokens", "take_tokens"]
    assert got.agg(F.sum("take_tokens")).first()[0] == (11 * 3 + 3 + 40001) // 2
    assert mixing.choose(empty_docs(spark).withColumn("domain", F.lit("d")), mix).count() == 0


def brute_contamination(docs, items, n=10):
    def tok(t):
        return [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower()) if w]
    out = []
    wins = {(i, tuple(w[j:j + n])) for i, t in items if i is not None for w in [tok(t)] if w for j in range(max(1, len(w) - n + 1))}
    for d, t in docs:
        w, hit, found = tok(t), set(), set()
        for i, win in wins:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j:j + len(win)]) == win:
                    hit.update(range(j, j + len(win))), found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark):
    items = [(1, "c d e f g h i j k, l m"), (2, "a"), (2, "x Y"), (10, "the the the the the the the the the the the"), (3, None),
             (None, "x"), (4, ""), (5, "not in any document at all")]
    texts = [(20, "the " * 30), (21, "x y the " * 10), (22, "b c d e f g h i j k l m n"), (23, "B-c.D e f g h i j k l"), (24, "x y")] * 2
    docs = odd_docs(spark, texts)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((tuple(r) for r in found.select(*cols).collect()), key=str)
    assert got == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, none).where("contaminated").count() == 0
    assert decontamination.contamination(empty_docs(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red fox jumps high"), (2, "red big fox then jumps high"), (3, "high jumps fox red"), (4, "red fox")],
                                 "doc_id long, text string")
    wins = spark.createDataFrame([(0, ["red", "fox", "jumps"], 3)], "win long, words array<string>, n int")
    index = decontamination.build_index(docs, wins.select(F.explode("words").alias("word")))
    def ids(slop):
        found = decontamination.phrase_matches(index, wins, slop).join(index.headers, "uid")
        return sorted({r.doc_id for r in found.select("doc_id").collect()})
    assert ids(0) == [1] and ids(2) == [1, 2]


def test_pii_base_spans(spark):
    texts = [(30, "mail a.b@x.org, c@d and e@f.co.uk."), (31, "ip 1.2.3.4.5 256.1.1.1 9.9.9.9 é 10.0.0.1"),
             (32, "card 4539 1488 0343 6467 or 4539148803436468, 4539-1488-0343-6467"), (33, "call +1 (605) 555-9305 or +12"),
             (34, "\u0001\u0002 x@y.zz \u0001"), (35, "a@b.c-d%x@y.z"), (36, "ü" * 50 + "+49 30 1234567 4539148803436467")]
    docs = odd_docs(spark, texts)
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(docs)).where("doc_id >= 30").collect()}
    rules = {k: re.compile(p) for k, p in pii.BASE.items()}
    def luhn(x):
        d = [int(c) for c in reversed(x)]
        return sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(d)) % 10 == 0
    for i, t in texts:
        base = []
        for kind, rx in rules.items():
            for m in rx.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0,
                        "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                    base.append(f"{kind}:{m.start()}:{m.end()}")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (t, base, got[i])
        assert set(base) <= set(got[i].spans.split(",")) | {""}
    assert pii.digest(pii.personal_data(empty_docs(spark))).count() == 0
    assert pii.personal_data(docs).count() == docs.count()


def test_pii_added_and_redacted(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
        rows.append((i, [f"call +1 ({n(3)}) 555-{n(4)} now", f"mail u{n(3)}@host.example.com now", f"in {n(4)} there were {n(9)} items",
                         "nothing here"][i % 4]))
    docs = spark.createDataFrame(rows + [(900, "call +1 (605) 555-9305 4078918989542222 now")], "doc_id long, text string")
    found = pii.personal_data(docs)
    clean = {r.doc_id: r.spans for r in pii.digest(found).collect()}
    assert all(clean[i] == "" for i in range(400) if i % 4 > 1)
    out = {r.doc_id: r.redacted for r in pii.redact(docs, found).collect()}
    assert out[0] == "call [phone] now" and out[1] == "mail [email] now" and out[3] == "nothing here"


def test_toxicity_learns_and_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        w = [f"w{int(x)}" for x in rng.integers(0, 300, 40)] + (["scum", "moron"] if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 200 and np.mean([p == y for p, y in held]) > 0.98
    index = toxicity.fit(docs, labels)
    for i in range(0, len(index.ids), 17):
        t = np.flatnonzero(index.x[i])
        cos = index.x @ index.x[i]
        want = [j for j in np.lexsort((index.ids, -np.round(cos, 12))) if cos[j] > 0][:25]
        rows_, c = index.nearest(t, index.x[i, t], 25)
        assert list(rows_) == want and np.allclose(c, cos[want])
    odd = toxicity.score_documents(odd_docs(spark), labels.limit(0))
    assert odd.count() == 10 and odd.where("score <> 0 or predicted <> 0").count() == 0
    assert toxicity.score_documents(empty_docs(spark), labels).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)]
    x[100:700] = x[100]  # equal vectors: ties go to the smaller id
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, []), (None, [1.0] * 16), (5100, [1.0])]
    df = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, df.where("vec_id % 20 = 0"), 20, ann.Tree(sample_rows=1000, leaf_rows=40, block_rows=100)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert len(got) == 150
    hits = []
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        s = np.array([sum(a * b for a, b in zip(x[q].tolist(), v)) for v in x.tolist()])
        assert all(abs(s[i] - sc) < 1e-12 for _, i, sc in found)
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        hits.append(len(set(best) & {i for _, i, _ in found}) / 20)
    assert np.mean(hits) >= 0.9
    tie = [i for _, i, _ in got[120]]
    assert tie == [i for i in range(100, 121) if i != 120][:20] or np.dot(x[tie[0]], x[120]) > np.dot(x[100], x[120])
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0


def test_patience_alignment():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = rng.integers(0, 8, rng.integers(0, 14)), rng.integers(0, 8, rng.integers(0, 14))
        pairs = line_dedup.common_lines(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    a = np.arange(50)
    b = np.concatenate([np.arange(100, 110), np.arange(10, 40), np.arange(200, 205)])
    assert line_dedup.common_lines(a, b) == [(i, i) for i in range(10, 40)]


def test_line_dedup(spark):
    line = lambda k: " ".join(f"{k}w{i}" for i in range(12))
    texts = [(50, "\n".join([line("a"), line("b"), "own fifty"])), (51, "\n".join(["first", line("a") + "  ", line("b"), "", "last"])),
             (52, "\n".join([line("c"), line("b")])), (53, "short\nlines"), (54, "short\nlines"), (55, line("a"))]
    docs = odd_docs(spark, texts)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).where("doc_id >= 50").collect()}
    assert got[50].n_removed == 0 and got[50].text == texts[0][1]
    assert (list(got[51].removed), got[51].text) == ([1, 2], "first\n\nlast")
    assert list(got[52].removed) == [1] and got[53].n_removed == got[54].n_removed == 0
    assert got[55].text == "" and got[55].n_lines == 1
    all_ = line_dedup.dedup_lines(docs)
    assert all_.count() == docs.count() and all_.where("doc_id = 3 and text is null and n_lines = 0").count() == 1
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def test_line_dedup_finds_every_partner(spark):
    """Copies of short lines that each stand alone in an earlier document, and passages that the earliest holder has in another order."""
    short = [" ".join(f"s{k}w{i}" for i in range(8)) for k in range(12)]
    a, b = (["\n".join(" ".join(f"{p}{k}w{i}" for i in range(12)) for k in range(3)) for p in "ab"])
    texts = [*((i + 1, f"own{i}\n{x}") for i, x in enumerate(short)), (100, "\n".join(short)), (200, "\n".join(short)),
             (300, f"{b}\n{a}"), (310, f"{a}\nown\n{b}"), (320, f"{a}\nother\n{b}")]
    rng = np.random.default_rng(7)
    pool = [" ".join(f"p{k}w{i}" for i in range(int(rng.integers(1, 13)))) for k in range(12)]
    texts += [(1000 + i, "\n".join(rng.choice(pool, int(rng.integers(1, 9))))) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: list(r.removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[100] == [] and got[200] == list(range(12)) and got[320] == [0, 1, 2, 4, 5, 6]
    lines = {i: np.array([zlib.crc32(x.encode()) for x in t.split("\n")]) for i, t in texts}
    for i, t in texts:
        n = np.array([len(x.split()) for x in t.split("\n")])
        want = {x for j in lines if j < i for x in line_dedup.blocks_to_delete(lines[i], lines[j], n, 10)}
        assert got[i] == sorted(want), i
        # Every line in a run of ten words that an earlier document has too, by plain comparison of all runs.
        covered = set()
        for x in range(len(n)):
            for y in range(x + 1, len(n) + 1):
                if n[x:y].sum() >= 10 and any(j < i and any((lines[j][z:z + y - x] == lines[i][x:y]).all()
                                                            for z in range(len(lines[j]) - (y - x) + 1)) for j in lines):
                    covered |= set(range(x, y))
        assert got[i] == sorted(covered), i


def test_line_dedup_pairs_grow_with_holders(spark, monkeypatch):
    """A line that stands twice in many documents, which differ besides: one pair a holder, not all pairs."""
    hot = " ".join(f"h{i}" for i in range(12))
    counts = []
    keep = line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: (lambda r: (counts.append(r[0].count()) if name == "line-pairs" else None, r)[1])(keep(df, name)))
    for n in (50, 200):
        docs = spark.createDataFrame([(i, f"own{i} a\n{hot}\nmid{i} b\n{hot}") for i in range(n)], "doc_id long, text string")
        got = {r.doc_id: list(r.removed) for r in line_dedup.dedup_lines(docs).collect()}
        assert got[0] == [] and all(got[i] == [1, 3] for i in range(1, n))
    assert counts == [49, 199]


def test_pii_long_runs(spark):
    digits = "".join(str(i * 7 % 10) for i in range(100_000))
    texts = [(1, digits), (2, " ".join(digits)), (3, "-".join(digits)), (4, "a@b" + ".c" * 50_000), (5, "+" + digits),
             (6, "x (at) y" + ".z" * 50_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = pii.spans(pii.find(docs)).where("kind in ('email', 'card', 'address')").collect()
    assert sorted((r.kind, r.start, r.end, r.base) for r in found) == [
        ("address", 0, 100_003, False), ("address", 0, 100_008, False), ("card", 0, 100_000, False), ("card", 0, 199_999, False),
        ("card", 0, 199_999, False), ("card", 1, 100_001, False), ("email", 0, 100_003, True)]


def test_pii_unbroken_million(spark):
    """Long unbroken texts next to a sign are read once, not from each of their characters."""
    n = 1_000_000
    texts = [(1, "a" * n + " @"), (2, "b" * n + " (at) " + "c" * n), (3, "é" * n + "@" + "x" * n), (4, "a@" + "b-" * (n // 2)),
             (5, "%" * n + "@d.e"), (6, "7" * n + " [at")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    began = time.time()
    found = pii.spans(pii.find(docs)).where("kind in ('email', 'address')").select("kind", "start", "end").collect()
    assert sorted(map(tuple, found)) == sorted([
        ("address", 0, 2 * n + 6), ("address", 0, 2 * n + 1), ("address", 0, n + 2), ("address", 0, n + 4), ("email", 0, n + 4)])
    assert time.time() - began < 120


def test_pii_emails_equal_plain_search(spark):
    rng = np.random.default_rng(12)
    texts = [(i, "".join(rng.choice(list("ab.@_%-é 1"), int(rng.integers(0, 60)), p=[.2, .1, .15, .15, .1, .05, .05, .05, .1, .05])))
             for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    parts = pii.find(docs)
    placed = pii.spans(parts).where("kind = 'email'").join(parts.where("kind is null").select("uid", "doc_id"), "uid")
    got = sorted((r.doc_id, r.start, r.end) for r in placed.select("doc_id", "start", "end").collect())
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert got == sorted((i, m.start(), m.end()) for i, t in texts for m in plain.finditer(t)) and len(got) > 100


def test_pii_adds_forms_the_base_rules_miss(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        n = lambda k: "".join(map(str, rng.integers(1, 10, k)))
        rows.append((i, [f"you can reach +1 ({n(3)}) 555-{n(4)} now", f"write to u{n(3)}@host.example.com now",
                         f"in {n(4)} there were {n(9)} items", f"see (at) {n(3)} for a @ b"][i % 4]))
    missed = [(900, "you can reach 1 (605) 555-9305 now", "phone:14:30"), (901, "you can reach (605) 555-9305 now", "phone:14:28"),
              (902, "write to u123 (at) host.example.com now", "email:9:35"), (903, "write to u123[at]host.example.com now", "email:9:33")]
    docs = spark.createDataFrame(rows + [m[:2] for m in missed], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.personal_data(docs)).collect()}
    assert [got[i] for i, _, _ in missed] == [want for _, _, want in missed]
    assert all(got[i] == "" for i in range(400) if i % 4 > 1)


def test_pii_learns_from_every_proposal(spark, monkeypatch):
    """No cap on what the trees and their thresholds are learned from."""
    docs = spark.range(2600).selectExpr(
        "id as doc_id", "concat('mail a', id, '@b.fi or +358 40 ', 1000000 + id, concat_ws(' x ', transform(sequence(1, 5), "
        "i -> concat(' no ', 1234567 + 5 * id + i)))) as text")
    rows, own = {}, pii.stage

    def counted(df, name):
        out = own(df, name)
        rows[name] = out[0]
        return out

    monkeypatch.setattr(pii, "stage", counted)
    assert pii.personal_data(docs).count() == 2600
    train = {(r.answer, r.rewritten): r["count"] for r in rows["pii-train"].groupBy("answer", "rewritten").count().collect()}
    assert train[(0.0, False)] == 13_000 and train[(1.0, False)] == 2 * 2600
    assert train[(1.0, True)] >= 13_000  # five forms of each address alone
