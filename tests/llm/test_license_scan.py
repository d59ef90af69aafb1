"""Licence scan against brute force, and on odd input."""

import collections
import math
import random
import re

from pyspark.sql import functions as F

from meterframe.llm import license_scan as L

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
SCHEMA = "doc_id long, text string, uid string, word long, template string, n long, share string, rare int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "u", 1, "t", 2, "s", 3) for r in rows], SCHEMA)


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows):
    docs = [tokens(t) for _, t in rows]
    df = collections.Counter(w for d in docs for w in set(d))
    weight = lambda w: math.floor(math.log10((len(docs) + 1) / (df[w] + 1)) * 1000 + 0.5) + 1
    out = []
    for (doc_id, _), d in zip(rows, docs):
        places, labels, base, score = [], set(), set(), 0.0
        for t in L.TEMPLATES:
            ws = [weight(w) for w in t.words]
            anchor = ws.index(max(ws))
            for start in range(-len(t.words), len(d)):
                agrees = [0 <= start + i < len(d) and d[start + i] == w for i, w in enumerate(t.words)]
                if not agrees[anchor]:
                    continue
                share = sum(w for w, a in zip(ws, agrees) if a) / sum(ws)
                ok = share >= L.LEAST_SHARE and all(agrees[i] for i in range(*t.key))
                score = max(score, share if ok else share / 2)
                if ok:
                    labels.add(t.label)
                    if t.base:
                        base.add(t.label)
                        places.append(start)
        out.append((doc_id, len(d), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


MIT = L.TEMPLATES[[t.label for t in L.TEMPLATES].index("mit", 4)]


def rows():
    rng = random.Random(4)
    vocabulary = sorted({w for t in L.TEMPLATES for w in t.words}) + ["the", "x", "é", "42"]
    some = [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    notices = [(100 + i, f"# Copyright 2020.\n# {' '.join(t.words).title()}, all rights") for i, t in enumerate(L.TEMPLATES)]
    text = list(MIT.words)
    one_off, broken = text[:], text[:]
    one_off[20] = "bundled"      # outside the key phrase: still found
    broken[text.index("hereby")] = "heerby"  # inside it: not found
    return some + notices + [
        (1, "GNU  General\nPublic-License; the MIT License. mit license"), (1, "GNU  General\nPublic-License; the MIT License. mit license"),
        (2, None), (3, ""), (None, "cc by"), (None, None), (4, "ccby cc. BY-NC 4.0"), (5, "öapache license Apacheé license apache\x00license"),
        (6, " ".join(one_off)), (7, " ".join(broken)), (8, "mit " * 50_000 + "license"), (9, "general public license version 3 tail of a notice"),
        (10, "free software released into the public domain")]


def test_licenses_against_brute_force(spark):
    given = rows()
    got = [tuple(r) for r in L.licenses(table(spark, given)).collect()]
    assert sorted(got, key=repr) == brute(given)
    by_id = {r[0]: r for r in got}
    assert by_id[1][2:7] == (3, 0, 7, "gpl,mit", "gpl,mit") and by_id[4][5:7] == ("cc-by", "cc-by,cc-by-nc")
    assert by_id[6][6] == "mit" and by_id[6][5] == "" and by_id[7][6] == ""
    for i, t in enumerate(L.TEMPLATES):
        assert t.label in by_id[100 + i][6].split(",")


def test_license_spans(spark):
    given = rows()
    spans = L.license_spans(table(spark, given)).where("doc_id = 1").groupBy("label", "start", "n").agg(F.count("*").alias("c")).collect()
    assert sorted(tuple(r) for r in spans) == [("gpl", 0, 4, 2), ("mit", 5, 2, 2), ("mit", 7, 2, 2)]


def test_no_documents(spark):
    assert L.licenses(table(spark, [])).count() == 0


def test_native(spark):
    plan = L.licenses(spark.range(3).select(F.col('id').alias('doc_id'), F.lit('mit license').alias('text')))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))
