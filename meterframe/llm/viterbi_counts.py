"""Token counts by a count-only Viterbi search over a unigram vocabulary.

For each text the best segmentation into vocabulary pieces (the largest sum of
piece scores) is found, but only its score and number of pieces are carried; no
segmentation is built. An Aho-Corasick automaton lists all pieces that end at
each character, longest first, so a segmentation replaces an equally good one
only if strictly better: of equal scores the one with the earliest start wins,
as in the tokenizer. A character that no single piece covers may be an unknown
piece with the lowest score less 10; with byte pieces it counts as its UTF-8
bytes, else neighbouring unknown characters count as one piece.

A space becomes U+2581 and one is put in front of the text. If no piece holds
that mark after another character, no piece crosses the start of a word, and a
text's best segmentation is that of its words one after the other: a task
remembers the words it has met (bounded) and searches each distinct one once.
Vocabularies without this property are searched over whole texts.

Defined results: a null or empty text has 0 pieces and score 0; rows are
counted one by one, repeats and null ids included; an empty table gives no rows;
very long texts are searched in time proportional to their length and memory
for one text. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: How far the unknown piece lies below the lowest score (fixed by the tokenizer).
UNKNOWN_PENALTY = 10.0
#: Words a task remembers, and the longest word worth remembering.
CACHE_WORDS, CACHE_CHARS = 1 << 19, 64


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    byte_pieces: bool

    @property
    def splits_at_words(self) -> bool:
        return not any(regex.search(f"[^{MARK}]{MARK}", p) for p, _ in self.pieces)


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file (read on the driver)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    n_bytes = sum(model.is_byte(i) for i in ids)
    return Vocabulary(tuple((model.id_to_piece(i), float(model.get_score(i))) for i in plain), n_bytes == 256)


class Counter:
    def __init__(self, v: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in v.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if v.pieces:
            self.automaton.make_automaton()
        self.any = bool(v.pieces)
        self.unknown = min((s for _, s in v.pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces, self.by_word = v.byte_pieces, v.splits_at_words
        self.words: dict[str, tuple[float, int]] = {}

    def search(self, text: str) -> tuple[float, int]:
        """Best score and its number of pieces."""
        n = len(text)
        score: list = [None] * (n + 1)
        count, single, in_unknown = [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        done = 0  # ends up to here have their unknown candidate

        def close(end: int) -> None:
            """The unknown piece that starts at end - 1 is the last candidate for an end."""
            if single[end]:
                return
            s = score[end - 1] + self.unknown
            if score[end] is None or s > score[end]:
                c = text[end - 1]
                if self.byte_pieces:
                    more = len(c.encode("utf-8", "surrogatepass"))
                else:
                    more = 0 if in_unknown[end - 1] else 1
                score[end], count[end], in_unknown[end] = s, count[end - 1] + more, True

        for last, (size, s) in self.automaton.iter(text) if self.any else ():
            end = last + 1
            while done < end - 1:
                done += 1
                close(done)
            start = end - size
            if size == 1:
                single[end] = True
            s += score[start]
            if score[end] is None or s > score[end]:
                score[end], count[end], in_unknown[end] = s, count[start] + 1, False
        while done < n:
            done += 1
            close(done)
        return score[n], count[n]

    def word(self, word: str) -> tuple[float, int]:
        got = self.words.get(word)
        if got is None:
            got = self.search(word)
            if len(word) <= CACHE_CHARS:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = got
        return got

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.search(marked)
        if MARK + MARK in marked:
            parts = regex.findall(f"{MARK}+[^{MARK}]*", marked)
        else:
            parts = [MARK + w for w in marked[1:].split(MARK)]
        word = self.word
        total, pieces = 0.0, 0
        for p in parts:
            s, c = word(p)
            total += s
            pieces += c
        return total, pieces


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_chars, n_tokens, best_score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a fixed vocabulary file

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            found = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([c for _, c in found], pa.int64()),
                 pa.array(np.array([s for s, _ in found], dtype=np.float64))],
                names=["doc_id", "n_chars", "n_tokens", "best_score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return src.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, best_score double")
