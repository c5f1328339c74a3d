"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the pieces that end at each place of a word; a
dynamic programme carries the best score and the number of pieces for every
prefix, and no back-pointers. Ties go to the piece that starts first (only a
strictly better score replaces what stands), as the tokenizers library's
unigram model has it. A character that no piece covers costs the least score
less 10; a run of such characters counts as one unknown, or, with byte pieces,
as one piece for each of its UTF-8 bytes.
"""

from __future__ import annotations

from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tiegrid.llm.common import map_texts, worker_object

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker keeps; past that it starts anew.
CACHE = 500_000


def unigram_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file in the order of their ids; control pieces are among them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of texts."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.by_bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, best score) of a word."""
        n = len(word)
        ending: list[list] = [[] for _ in range(n + 1)]
        for end, (size, score) in self.automaton.iter(word):
            ending[end + 1].append((size, score))
        best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        # Bytes of the run of unknown characters with which the best way to a place ends.
        run = [0] * (n + 1)
        for at in range(1, n + 1):
            found = sorted(ending[at], reverse=True)
            if not found or found[-1][0] != 1:
                found.append((1, None))
            for size, score in found:
                start = at - size
                total = best[start] + (self.unknown if score is None else score)
                if total > best[at]:
                    best[at] = total
                    if score is not None:
                        count[at], run[at] = count[start] + 1, 0
                    elif self.by_bytes:
                        width = len(word[start].encode())
                        count[at], run[at] = count[start] + width, run[start] + width
                    else:
                        count[at], run[at] = count[start] + (not run[start]), 1
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """(pieces, best score) of a text; a word is a stretch up to the next space, with the space before it."""
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if text[0] in (" ", SPACE):
            del words[0]
        total, score = 0, 0.0
        get = self.cache.get
        for w in words:
            made = get(w)
            if made is None:
                made = self.word(SPACE + w)
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                if len(w) < 100:
                    self.cache[w] = made
            total += made[0]
            score += made[1]
        return total, score


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score): pieces of every whole text under a unigram vocabulary, and their summed score.

    A text is cut before every space, which stays with the word after it, and
    begins as if a space stood before it. A null text counts as empty and has
    no pieces. Repeated rows each give their row; an empty table gives an empty
    result. The vocabulary is sent to every executor; its size is fixed by its
    file.
    """
    key = sha256(repr(pieces).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((key, pieces))

    def rows(texts: list[bytes]) -> list[pa.Array]:
        key, pieces = shared.value
        counter = worker_object("tokencount", key, lambda: Counter(pieces))
        made = [counter.text(t.decode()) for t in texts]
        return [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.float64())]

    return map_texts(docs, rows, "n_tokens bigint, score double", id_col, text_col, "tokencount")
