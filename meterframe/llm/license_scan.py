"""Licence scan with a positional index of rare words.

Licence notices are short templates: their words with positions, and key phrases
that must stand in a file for the template to count. A word weighs its inverse
document frequency over all documents. A file's rarest licence words open the
templates whose rarest word (anchor) they are; only such a file's words of the
opened templates become postings. Postings meet the template's postings by word,
and their difference in position tells at which word of the file the template
would start: words that agree on a start add up their weights. A template is
found where its anchor and all words of its key phrases stand at their places
and the words that agree hold ``least_share`` of its weight.

A plain phrase is a template whose key phrase is all of it, so its places are
exact and complete.

All of it is DataFrame work: two passes over the texts (frequencies, postings),
one aggregate by (document, template, start) and one by document, both over the
few documents that have postings. Only counts
of the templates' words come to the driver, and only templates are broadcast;
both are as large as the templates, whatever the input.

Defined results: a null or empty text has no words, no labels and score 0; rows
may repeat and ids may be null, each row has its own result; an empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.llm.common import stage
from meterframe.llm.decontamination import words

# Base phrases and their labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Public notices (label, words, key phrase that must stand).
NOTICES = (
    ("gpl-2.0", "gnu general public license version 2", "public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "public license version 3"),
    ("gpl-2.0", "spdx license identifier gpl 2 0", "license identifier gpl 2 0"),
    ("gpl-3.0", "spdx license identifier gpl 3 0", "license identifier gpl 3 0"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "spdx license identifier apache 2 0", "license identifier apache 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction",
     "permission is hereby granted free of charge"),
    ("mit", "spdx license identifier mit", "license identifier mit"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "spdx license identifier bsd", "license identifier bsd"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", "permission to use copy modify and or distribute"),
    ("isc", "spdx license identifier isc", "license identifier isc"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("mpl-2.0", "spdx license identifier mpl 2 0", "license identifier mpl 2 0"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original "
             "software", "altered source versions must be plainly marked"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
)
LEAST_SHARE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # places of the key phrase in it, end exclusive
    base: bool

    @staticmethod
    def of(label: str, text: str, key: str, base: bool = False) -> "Template":
        own, k = tuple(text.split()), tuple(key.split())
        at = next(i for i in range(len(own) - len(k) + 1) if own[i:i + len(k)] == k)
        if len(own) > 63:
            raise ValueError("a template has 63 words at most")
        return Template(label, own, (at, at + len(k)), base)


TEMPLATES = (*(Template.of(label, text, text, True) for label, text in BASE), *(Template.of(*n) for n in NOTICES))


@dataclass(frozen=True)
class Index:
    """Templates weighed by the frequencies of their words; ``anchors``: (word, words of the templates it opens), rarest first."""
    templates: tuple[Template, ...]
    weights: dict[str, int]

    def anchor(self, t: Template) -> int:
        """Place of the template's rarest word (ties: the first)."""
        return max(range(len(t.words)), key=lambda i: (self.weights[t.words[i]], -i))

    @property
    def anchors(self) -> list[tuple[str, list[str]]]:
        opened: dict[str, set[str]] = {}
        for t in self.templates:
            opened.setdefault(t.words[self.anchor(t)], set()).update(t.words)
        return [(w, sorted(opened[w])) for w in sorted(opened, key=lambda w: (-self.weights[w], w))]

    def postings(self, spark: SparkSession) -> DataFrame:
        """(word, template, off, weight, anchor): as many rows as the templates have words."""
        rows = [(w, n, i, self.weights[w], i == self.anchor(t))
                for n, t in enumerate(self.templates) for i, w in enumerate(t.words)]
        return _small_table(spark, rows, "word string, template int, off int, weight long, anchor boolean")

    def heads(self, spark: SparkSession) -> DataFrame:
        """(template, label, base, total, key_mask, n): one row a template."""
        rows = [(n, t.label, t.base, sum(self.weights[w] for w in t.words), sum(1 << i for i in range(*t.key)), len(t.words))
                for n, t in enumerate(self.templates)]
        return _small_table(spark, rows, "template int, label string, base boolean, total long, key_mask long, n int")


def _small_table(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A table of literals: no Python worker reads it."""
    columns = [f.split() for f in fields.split(", ")]
    structs = [F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, columns))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _texts(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def weigh(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> Index:
    """Weights, in thousandths of log10((N + 1) / (n + 1)) and one more, from all documents."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = words(docs.select("text")).select(F.array_intersect("words", _texts(vocabulary)).alias("held"))
    # A row for no word stands for the document itself.
    counts = held.select(F.explode(F.concat(F.array(F.lit("")), "held")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = {r["word"]: r["n"] for r in counts.collect()}  # as many rows as the templates have words, and one
    every = n.get("", 0)
    return Index(templates, {w: math.floor(math.log10((every + 1) / (n.get(w, 0) + 1)) * 1000 + 0.5) + 1 for w in vocabulary})


def _postings(docs: DataFrame, index: Index) -> DataFrame:
    """(uid, doc_id, n_words, hits): hits are (pos, word) of the words of the templates that the file's rare words open."""
    own = words(docs.select("doc_id", "text")).withColumn("n_words", F.size("words").cast("long"))
    anchors = index.anchors
    rare = F.array_intersect(_texts([w for w, _ in anchors]), F.col("words"))
    opened = F.array_distinct(F.flatten(F.transform("rare", lambda a: F.coalesce(
        *(F.when(a == w, _texts(of)) for w, of in anchors)))))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    found = F.filter(placed, lambda p: F.array_contains(F.col("opened"), p["word"]))
    kind = "array<struct<pos:int,word:string>>"
    return (own.withColumn("rare", rare)
            .withColumn("opened", F.when(F.size("rare") > 0, opened))
            .withColumn("hits", F.when(F.size("rare") > 0, found).otherwise(F.array().cast(kind)))
            .select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_words", "hits"))


def alignments(postings: DataFrame, index: Index, least_share: float = LEAST_SHARE) -> DataFrame:
    """(uid, template, label, base, start, n, share, found) for each start of a template that its anchor agrees on."""
    spark = postings.sparkSession
    hits = postings.select("uid", F.explode("hits").alias("h")).select("uid", "h.pos", "h.word")
    met = hits.join(F.broadcast(index.postings(spark)), "word")  # as large as the templates
    start = met.withColumn("start", F.col("pos") - F.col("off"))
    agreed = (start.groupBy("uid", "template", "start")
              .agg(F.sum("weight").alias("got"), F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask"), F.bool_or("anchor").alias("anchored"))
              .where(F.col("anchored")).join(F.broadcast(index.heads(spark)), "template"))
    share = F.col("got") / F.col("total")
    found = (F.col("mask").bitwiseAND(F.col("key_mask")) == F.col("key_mask")) & (share >= least_share)
    return agreed.select("uid", "template", "label", "base", "start", "n", share.alias("share"), found.alias("found"))


def licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row a document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``score``: the largest share of a template's weight at one start, halved
    where the template is not found; 0 where no anchor stands.
    """
    index = weigh(docs, templates)
    rows, _ = stage(_postings(docs, index), "license-postings")
    each = alignments(rows, index, least_share)
    base = F.col("base") & F.col("found")

    def listed(cond):
        return F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("label")))), ",")

    by_doc = each.groupBy("uid").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"), listed(base).alias("base_labels"),
        listed(F.col("found")).alias("labels"),
        F.max(F.when(F.col("found"), F.col("share")).otherwise(F.col("share") / 2)).alias("score"))
    none, nothing = F.lit(""), F.lit(None).cast("long")
    # A document without postings needs no shuffle.
    plain = rows.where(F.size("hits") == 0).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), nothing.alias("first_word"), nothing.alias("last_word"),
        none.alias("base_labels"), none.alias("labels"), F.lit(0.0).alias("score"))
    marked = rows.where(F.size("hits") > 0).select("uid", "doc_id", "n_words").join(by_doc, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
    return plain.unionByName(marked)


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, label, start, n, share): each place where a template is found, in words of the document."""
    index = weigh(docs, templates)
    rows, _ = stage(_postings(docs, index), "license-postings")
    found = alignments(rows, index, least_share).where(F.col("found"))
    return rows.select("uid", "doc_id").join(found, "uid").select("doc_id", "label", "start", "n", "share")
