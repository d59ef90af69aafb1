"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from meterframe.llm import pipeline_stages as P

from .test_operators import brute_components, brute_contamination, brute_shard, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def corpus():
    """(rows, labels): clean, toxic, copied, contaminated, empty and null texts."""
    rng = np.random.default_rng(8)
    text = lambda n: [f"w{int(x)}" for x in rng.integers(0, 900, n)]
    rows, labels = [], []
    for i in range(900):
        w = text(int(rng.integers(8, 60)))
        if i % 5 == 0:
            w[3:3] = ["scum", "moron"]
        if i % 5 == 1 and i % 7 == 0:
            w[4:4] = ITEM.split()[1:11]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(900, 960):  # copies, exact and with one word changed at the end
        w = rows[(i % 12) * 5 + 2][1].split()
        rows.append((i, " ".join(w if i % 2 else [*w[:-1], f"x{i}"])))
    rows += [(1000, ""), (1001, None), (1002, " \n ")]
    sources = ["src0", "src1", "src2", "src5", "web", None]
    langs = ["en", "en", "de", None]
    full = [(i, t, langs[i % 4], sources[i % 6] if i % 3 else "src0", len(t or "")) for i, t in rows]
    return full, labels


def brute_near(rows):
    found, _ = brute_components({r[0]: r[1] for r in rows}, P.SHINGLE, *P.SIMILARITY)
    return {r[0] for r in rows if found[r[0]] == r[0]}


def fill(budget, kids):
    """Shares of ``budget`` for {name: (cap, weight)}."""
    out, left, open_ = {}, budget, dict(kids)
    for name, (cap, w) in sorted(kids.items(), key=lambda x: (x[1][0] / x[1][1], x[0])):
        if cap * sum(v for _, v in open_.values()) > w * left:
            break
        out[name], left = cap, left - cap
        del open_[name]
    total, upto = sum(v for _, v in open_.values()), 0
    for name in sorted(open_):
        upto += open_[name][1]
        out[name] = left * upto // total - left * (upto - open_[name][1]) // total
    return out


def brute_mix(rows):
    null = lambda x: "<null>" if x is None else x
    leaves = {}
    for i, t, lang, source, _ in rows:
        n = re.search("([0-9]+)$", source or "")
        leaf = (f"domain{int(n[1]) % 4}" if n else "other", null(lang), null(source))
        leaves.setdefault(leaf, []).append((hashlib.md5(f"17:0:{i}".encode()).hexdigest(), len(words(t)), i))
    tokens = {leaf: sum(n for _, n, _ in docs) for leaf, docs in leaves.items()}
    budgets = {(): sum(tokens.values()) * 8 // 10}
    for depth in (1, 2, 3):
        caps = {}
        for leaf, n in tokens.items():
            caps[leaf[:depth]] = caps.get(leaf[:depth], 0) + n
        level = {}
        for above, b in budgets.items():
            level.update(fill(b, {k: (c, P.WEIGHTS.get(k, 1)) for k, c in caps.items() if k[:-1] == above}))
        budgets = level
    kept = set()
    for leaf, docs in leaves.items():
        left = budgets[leaf]
        if 0 < left == tokens[leaf]:
            kept.update(i for _, _, i in docs)
            continue
        for _, n, i in sorted(docs):
            if left <= 0:
                break
            kept.add(i)
            left -= n
    return kept


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    rows, labels = corpus()
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_each_stage_on_its_own_input(spark, corpus_dir):
    rows, labels = corpus()
    toxic = {i for i, _, y in labels if y}
    stages, last = dict(corpus_pipeline.STAGES), None
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    for name, fn in corpus_pipeline.STAGES:
        out = fn(spark, docs, corpus_dir)
        got = sorted((tuple(r) for r in out.collect()), key=str)
        if name == "sharding":
            last = out
            break
        if name == "toxicity":
            want = {r[0] for r in rows} - toxic
        elif name == "near_duplicates":
            want = brute_near(rows)
        elif name == "decontamination":
            want = {r[0] for r in brute_contamination([r[:2] for r in rows], [(1, ITEM)]) if not r[-1]}
        else:
            want = brute_mix(rows)
        assert 0 < len(want) < len(rows)
        rows = [r for r in rows if r[0] in want]
        assert out.columns == docs.columns
        assert got == sorted(rows, key=str), name
        docs = spark.createDataFrame(rows, COLUMNS)
    assert [(r.doc_id, r.shard, r.grown_shard) for r in last.orderBy("doc_id").collect()] == [
        (i, brute_shard(str(i), 24), brute_shard(str(i), 25)) for i in sorted(r[0] for r in rows)]
    whole = corpus_pipeline.run(spark, corpus_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last.collect()))


def test_odd_rows_and_clashing_columns(spark, corpus_dir):
    extra = ", domain string, epoch int, n_tokens int, uid long, keep_0 string, own_0 string, kept_0 string"
    more = ("mine", 1, 2, 3, "k", "o", "e")
    rows = [(1, "a b c d e f", "en", "src1", 11), (1, "a b c d e f", "en", "src1", 11), (None, "x y z", None, None, None),
            (None, None, None, None, None), (4, " ".join(f"w{i}" for i in range(20_000)), "en", "src2", 9)]
    for given in ([r + more for r in rows], []):
        docs = spark.createDataFrame(given, COLUMNS + extra)
        for name, fn in corpus_pipeline.STAGES[:-1]:
            out = fn(spark, docs, corpus_dir)
            got = [tuple(r) for r in out.collect()]
            assert out.columns == docs.columns and set(got) <= set(given), name
            assert name == "mixing" or set(got) == set(given), name
            assert not given or name != "near_duplicates" or got.count(given[0]) == 1
        assert P.shard(spark, docs, corpus_dir).count() == len(given)


def test_near_duplicates_without_ids_or_with_equal_ids(spark):
    base = [f"w{i}" for i in range(120)]
    near = lambda at: " ".join([*base[:at], "other", *base[at + 1:]])
    rows = [(None, near(5)), (None, near(60)), (None, near(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert P.drop_near_duplicates(spark, docs, "").count() == 1
    docs = spark.createDataFrame([(7, near(5)), (7, near(60)), (None, near(90)), (8, "left alone")], "doc_id long, text string")
    assert [r.doc_id for r in P.drop_near_duplicates(spark, docs, "").orderBy("doc_id").collect()] == [7, 8]
