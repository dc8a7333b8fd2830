"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; a dynamic
program over characters carries only the best score and the count of pieces on the best way.
Ties go as in the tokenizers library's unigram model: of several best ways to a place the one
whose last piece is longest (the one found from the earliest start) wins, since a later
start has to be strictly better.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

SPACE = "▁"
#: Score of an unknown character below the lowest score of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Chunks of text whose counts a task remembers, and their longest length.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64
_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def piece_scores(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class PieceCounter:
    """Best score and piece count of texts; see the module for ties.

    A character that no piece covers is unknown; a run of unknown characters is one
    piece, or its UTF-8 bytes if the vocabulary has all byte pieces (``<0x00>`` to ``<0xFF>``).
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        scores: dict[str, float] = {}
        for piece, score in pieces:
            scores[piece] = score
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{k:02X}>" in scores for k in range(256))
        self.find = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.find.add_word(piece, (len(piece), score))
        if len(self.find):
            self.find.make_automaton()
        # A way always passes between a letter and a following space mark if no piece crosses there.
        # Chunks then add up exactly as long as sums of scores are exact, as for whole numbers.
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores)
        self.separable = not crossing and all(float(s).is_integer() for s in scores.values())
        self.known: dict[str, tuple[float, int]] = {}

    def chunk(self, text: str) -> tuple[float, int]:
        """Score and count over one piece of text, by the full dynamic program."""
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.find):
            for end, match in self.find.iter(text):
                ending[end + 1].append(match)
        single = [False] * n
        for end in range(1, n + 1):
            single[end - 1] = any(size == 1 for size, _ in ending[end])
        best = [-math.inf] * (n + 1)
        count = [0] * (n + 1)
        tail = [0] * (n + 1)  # unknown characters that the way ends with
        best[0] = 0.0
        for end in range(1, n + 1):
            top, pieces, unknown = -math.inf, 0, 0
            # earliest start first; a later start has to be strictly better
            for size, score in sorted(ending[end], reverse=True):
                start = end - size
                if best[start] + score > top:
                    top, pieces, unknown = best[start] + score, count[start] + 1, 0
            if not single[end - 1] and best[end - 1] + self.unknown > top:
                top, unknown = best[end - 1] + self.unknown, tail[end - 1] + 1
                width = len(text[end - 1].encode()) if self.bytes else 0 if tail[end - 1] else 1
                pieces = count[end - 1] + width
            best[end], count[end], tail[end] = top, pieces, unknown
        return best[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        """Score and count of a text; spaces become marks, with one more in front."""
        if not text:
            return 0.0, 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.separable:
            return self.chunk(marked)
        score, pieces = 0.0, 0
        known = self.known
        for part in _CHUNKS.findall(marked):
            found = known.get(part)
            if found is None:
                found = self.chunk(part)
                if len(part) <= REMEMBERED_CHARS and len(known) < REMEMBERED:
                    known[part] = found
            score += found[0]
            pieces += found[1]
        return score, pieces


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``score`` (of the best way) for every document row.

    The vocabulary is a parameter of fixed size and is sent to the tasks.  Rows are counted where they are
    read.  A null or empty text has no tokens and score 0.  A text that no way covers cannot
    occur, since unknown characters are always allowed.  Repeated rows are each counted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def work(batches):
        counter = PieceCounter(shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                found = [counter.count(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.array([n for _, n in found], np.int64)),
                        pa.array(np.array([s for s, _ in found], np.float64)),
                    ],
                    ["doc_id", "n_tokens", "score"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return frame.mapInArrow(work, f"doc_id {kind}, n_tokens long, score double")
