"""Count-only Viterbi over a unigram vocabulary.

The number of tokens of the best segmentation, without the tokens themselves.
An Aho-Corasick automaton enumerates all vocabulary matches of a chunk by their
ends; a table over positions carries the best score and its number of pieces.
The tie rule is that of the unigram tokenizers: of equal scores the piece that
starts first (the longest) wins, because positions are visited in order and only
a greater score replaces an entry. Where no piece of one character matches,
the unknown piece stands in with the lowest score less 10, and counts as many
tokens as it has bytes (byte fallback).

Spaces become U+2581 and one is put in front, as the tokenizer does. No piece
of the vocabulary holds U+2581 after another character, so that the text falls
apart in front of each run of spaces that follows another character, and chunks
are solved once a worker and then looked up.

The box has no unigram vocabulary; the pieces and scores of the public
32k piece vocabulary are read as one. They are read from its file, whose path is
a parameter; nothing is trained.

Edge cases: null and empty texts have 0 tokens (the tokenizer gives none);
texts are read whole; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodegraf.llm.common import map_texts, texts_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_CACHE_MAX = 1_000_000
#: Chunks longer than this are not kept in the table of solved ones.
_CACHE_CHARS = 64
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def public_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids]


@dataclass
class Counter:
    pieces: list[tuple[str, float]]
    solved: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.auto = ahocorasick.Automaton()
        for piece, score in self.pieces:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = {p for p, _ in self.pieces if len(p) == 1}
        #: No piece holds a line end, so that it is a token of its own and parts the text.
        self.newline_alone = not any("\n" in p for p, _ in self.pieces)
        self.unknown = min((s for _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) for p, _ in self.pieces):
            raise ValueError("a piece holds the space mark after another character: chunks would not be independent")

    def viterbi(self, chunk: str) -> int:
        """Tokens of the best segmentation of one chunk."""
        n = len(chunk)
        best, count = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        done = 0  # positions up to here are final
        for last, (length, score) in self.auto.iter(chunk):  # by end, and of one end the longest first
            while done < last:
                done += 1
                self._settle(chunk, done, best, count)
            s = best[last + 1 - length] + score
            if s > best[last + 1]:
                best[last + 1] = s
                count[last + 1] = count[last + 1 - length] + 1
        while done < n:
            done += 1
            self._settle(chunk, done, best, count)
        return count[n]

    def _settle(self, chunk: str, end: int, best: list[float], count: list[int]) -> None:
        c = chunk[end - 1]
        if c not in self.single:
            s = best[end - 1] + self.unknown
            if s > best[end]:
                best[end] = s
                count[end] = count[end - 1] + len(c.encode("utf-8", "surrogatepass"))

    def _line(self, line: str, first: bool) -> int:
        """Tokens of a line; first: whether the mark in front of the text belongs to it."""
        words = line.split(" ")
        if "" in words or SPACE in line:  # runs of spaces, or marks in the text itself
            chunks = CHUNK.findall((SPACE if first else "") + line.replace(" ", SPACE))
        else:
            chunks = [SPACE + words[0] if first else words[0], *[SPACE + w for w in words[1:]]]
        found = list(map(self.solved.get, chunks))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    found[i] = n = self.viterbi(chunks[i])
                    if len(chunks[i]) <= _CACHE_CHARS:
                        self.solved[chunks[i]] = n
        return sum(found)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if len(self.solved) > _CACHE_MAX:
            self.solved.clear()
        if not self.newline_alone:
            return self._line(text, True)
        lines = text.split("\n")
        return sum(self._line(line, i == 0) if line or i == 0 else 0 for i, line in enumerate(lines)) + len(lines) - 1


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(read_pieces(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens."""
    path = path or public_path()

    def make():
        count = counter(path)

        def run(batch):
            texts = texts_of(batch)
            return {"doc_id": batch.column("doc_id"), "n_chars": [len(t) for t in texts], "n_tokens": [count(t) for t in texts]}

        return run

    return map_texts(docs, make, "doc_id long, n_chars long, n_tokens long", [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")])
