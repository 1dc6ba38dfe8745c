"""Token counts without tokens: a Viterbi search that carries best score and piece count only.

The vocabulary (pieces with scores) becomes an Aho-Corasick automaton. It lists, for each end in a
word, the pieces that end there, longest first; the best path to that end keeps its score and its
number of pieces. Tie rule of the unigram tokenizer: of equal scores the earliest start stays. A
character without a piece of its own costs the lowest score less ``UNKNOWN_PENALTY`` and counts as
its UTF-8 bytes (byte fallback), or one per run of such characters without byte fallback.

Words are cut before blanks, as the tokenizer does, and each carries its blank as a mark. Counts
of words already seen are kept in a bounded table per task; longer words are always searched anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS, KEPT_LENGTH = 300_000, 64

Vocabulary = list[tuple[str, float]]


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model, control, unknown and byte pieces left out.

    A merge vocabulary's scores are negative ranks; each piece then gets the log of a Zipf share
    of its rank. Files of the unigram kind keep their scores.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if all(score == int(score) for _, score in pieces):
        return [(piece, -math.log(2.0 - score)) for piece, score in pieces]
    return pieces


class Counter:
    """Counts the pieces of texts for one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        after_unknown = [False] * (n + 1)
        last = 0

        def close(end: int) -> None:
            """The last character of an end without a piece of one character."""
            score = best[end - 1] + self.unknown
            if best[end] is None or score > best[end]:
                best[end] = score
                if self.byte_fallback:
                    more = len(word[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    more = 0 if after_unknown[end - 1] else 1
                count[end] = count[end - 1] + more
                after_unknown[end] = True

        single = False
        for at, (length, value) in self.automaton.iter(word) if n else ():
            end = at + 1
            if end != last:
                if last and not single:
                    close(last)
                for missed in range(last + 1, end):
                    close(missed)
                last, single = end, False
            score = best[end - length] + value
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[end - length] + 1
                after_unknown[end] = False
            single = single or length == 1
        if last and not single:
            close(last)
        for missed in range(last + 1, n + 1):
            close(missed)
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", BLANK)
        parts = marked.split(BLANK)
        if marked[0] == BLANK:
            del parts[0]
        total, seen = 0, self.seen
        for part in parts:
            n = seen.get(part)
            if n is None:
                n = self.word(BLANK + part)
                if len(part) <= KEPT_LENGTH:
                    if len(seen) >= KEPT_WORDS:
                        seen.clear()
                    seen[part] = n
            total += n
        return total


def token_counts(docs: DataFrame, vocabulary: Vocabulary, byte_fallback: bool = True) -> DataFrame:
    """doc_id and n_tokens of every whole text.

    A null or empty text has no tokens; texts have no length limit; repeated rows and null ids
    give a row each; an empty table gives an empty result; other columns are ignored. The
    vocabulary goes to every task; it is a tokenizer's, some ten thousand pieces.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, byte_fallback)
        for batch in batches:
            counts = [counter.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(
        count, f"doc_id {id_type}, n_tokens long")
