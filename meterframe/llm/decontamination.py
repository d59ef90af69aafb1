"""Benchmark decontamination with a positional inverted index.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. The index is
a stored table of postings (document, position, term) of the corpus for the
words of the benchmark, written in one pass; one header row a document holds its
id and number of words.

A benchmark item's windows are its runs of ``window`` words (a shorter item is
one window). A window is looked up from its rarest term: that term's postings,
moved back by its place in the window, are the possible starts. The list is
then intersected with the offset-adjusted postings of the second rarest term,
and what remains with those of all other terms at once. ``slop`` lets each
further term lie up to that many words from its place (proximity matches);
0 gives exact phrases.

Everything is DataFrame work. Postings stay dealt by document until a term's
share of them is asked for, so a word that fills a third of the corpus is no hot
key: it is only read where a rarer term has already matched.

Defined results: rows of either table may repeat (each gets its own result);
items with a null id and items without words are no items; a null or empty
document has no words and is clean; empty tables give no hits. Only doc_id and
text, item_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import BROADCAST_ROWS, ascii_lower, small, stage

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No word: marks the header row of a document.
HEADER = "\u0001"

def words(df: DataFrame, column: str = "text", to: str = "words") -> DataFrame:
    parts = df.withColumn("__w", F.split(ascii_lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), WORD_GAP))
    lead = (F.element_at("__w", 1) == "").cast("int")
    tail = ((F.size("__w") > 1) & (F.element_at("__w", -1) == "")).cast("int")
    return parts.withColumn(to, F.slice("__w", lead + 1, F.size("__w") - lead - tail)).drop("__w")


@dataclass
class Index:
    """``postings``: (uid, pos, term); ``headers``: (uid, doc_id, text_hash, n_words); ``terms``: (word, term, freq)."""
    postings: DataFrame
    headers: DataFrame
    terms: DataFrame
    path: str


def build_index(docs: DataFrame, vocabulary: DataFrame) -> Index:
    """Postings of ``docs`` for the words of ``vocabulary`` (column ``word``)."""
    spark = docs.sparkSession
    numbered = vocabulary.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    numbered, _ = stage(numbered, "index-terms")
    every = numbered.unionByName(spark.range(1).select(F.lit(HEADER).alias("word"), F.lit(-1).cast("long").alias("term")))
    own = words(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("uid")))
    marked = own.select("uid", "doc_id", "text_hash", F.size("words").alias("n_words"),
                        F.posexplode(F.concat(F.array(F.lit(HEADER)), "words")).alias("pos", "word"))
    few = numbered.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = marked.join(F.broadcast(every) if few else every, "word")
    rows = rows.select("uid", "doc_id", "text_hash", "n_words", (F.col("pos") - 1).alias("pos"), "term")
    index, path = stage(rows, "index")
    postings = index.where(F.col("term") >= 0).select("uid", "pos", "term")
    freq = postings.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    terms, _ = stage(numbered.join(freq, "term"), "index-freq")
    return Index(postings, index.where(F.col("term") < 0).select("uid", "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words")),
                 terms, path)


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, words, n) and which items hold them (win, item_id)."""
    own = words(items.where(F.col("item_id").isNotNull()).select("item_id", "text")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    each = own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, window))).alias("words")).distinct()
    each, _ = stage(each, "item-windows")
    wins, _ = stage(each.select("words").distinct().withColumn("win", F.monotonically_increasing_id())
                    .withColumn("n", F.size("words")), "windows")
    return wins, each.join(wins, "words").select("win", "item_id").distinct()


def phrase_matches(index: Index, windows: DataFrame, slop: int = 0) -> DataFrame:
    """(uid, win, start, n) for each occurrence of a window (win, words, n)."""
    terms = windows.select("win", "n", F.posexplode("words").alias("off", "word")).join(index.terms, "word")
    by_win = Window.partitionBy("win")
    ranked = (terms.withColumn("found", F.count(F.lit(1)).over(by_win)).where(F.col("found") == F.col("n"))
              .withColumn("rank", F.row_number().over(by_win.orderBy("freq", "off")))
              .select("win", "n", "off", "term", "rank"))
    ranked, _ = stage(ranked, "window-terms")
    rarest = ranked.where(F.col("rank") == 1).select("win", "n", "off", "term")
    starts = (index.postings.join(small(rarest), "term").withColumn("start", F.col("pos") - F.col("off"))
              .where(F.col("start") >= 0).select("uid", "win", "n", "start"))
    starts, _ = stage(starts.distinct(), "phrase-starts")
    second = _intersect(index, starts.where(F.col("n") > 1), ranked.where(F.col("rank") == 2), 1, slop)
    second, _ = stage(second, "phrase-second")
    rest = _intersect(index, second.where(F.col("n") > 2), ranked.where(F.col("rank") > 2), None, slop)
    done = starts.where(F.col("n") == 1).unionByName(second.where(F.col("n") == 2)).unionByName(rest)
    return done.select("uid", "win", "start", "n")


def _intersect(index: Index, starts: DataFrame, terms: DataFrame, terms_each: int | None, slop: int) -> DataFrame:
    """Starts at which all of their window's ``terms`` lie at their place (``terms_each`` of them; None: all but two)."""
    wanted = starts.join(small(terms.drop("n", "rank")), "win")
    place = F.col("start") + F.col("off")
    wanted = wanted.withColumn("pos", F.explode(F.sequence(place - slop, place + slop)) if slop else place)
    # Only postings of documents and terms that are still in question are moved.
    near = (index.postings.join(small(terms.select("term").distinct()), "term", "left_semi")
            .join(small(starts.select("uid").distinct()), "uid", "left_semi"))
    met = wanted.join(near, ["uid", "pos", "term"])
    seen = F.bit_or(F.expr("shiftleft(1L, off)"))  # repeated postings count once
    need = F.col("n") - 2 if terms_each is None else F.lit(terms_each)
    return (met.groupBy("uid", "win", "start", "n").agg(seen.alias("seen"))
            .where(F.bit_count("seen") == need).select("uid", "win", "n", "start"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) for each document."""
    if not 1 <= window <= 63:
        raise ValueError("window must be 1 to 63 words")
    wins, holders = item_windows(items, window)
    index = build_index(docs, wins.select(F.explode("words").alias("word")))
    found, _ = stage(phrase_matches(index, wins), "phrases")
    hit = (found.select("uid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
           .distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("n_hit")))
    names = (found.select("uid", "win").distinct().join(small(holders), "win").select("uid", F.col("item_id").cast("string").alias("item"))
             .distinct().groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items")))
    out = index.headers.join(hit, "uid", "left").join(names, "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                      items_.alias("items"), "text_hash")
