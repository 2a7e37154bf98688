"""Token counts by a count-only Viterbi search over a unigram vocabulary: an
Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character, and dynamic programming carries the best score and its piece count.

Tie rules: a later start replaces an earlier one only if its score is
greater, so of equal segmentations the one with the longer last piece wins. A character
that no piece covers alone costs 10 less than the least score and counts as its UTF-8
bytes (byte fallback) or, without fallback, as one piece with the unknown
characters next to it. Scores are added in double precision."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import each_text, map_arrow

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words whose result a task remembers, and the longest of them.
REMEMBERED = 400_000
REMEMBERED_CHARS = 64
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def load_pieces(path: str) -> tuple[tuple[tuple[str, float], ...], bool]:
    """((piece, score) ..., byte fallback) of a sentencepiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    return tuple((p.piece, p.score) for p in m.pieces if p.type == p.NORMAL), m.trainer_spec.byte_fallback


class Counts:
    """Best score and piece count of texts, by words where no piece crosses into the next word."""

    def __init__(self, pieces, byte_fallback: bool):
        self.automaton, self.fallback, self.memory = ahocorasick.Automaton(), byte_fallback, {}
        for p, score in pieces:
            self.automaton.add_word(p, (len(p), score))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.by_words = all(SPACE not in p.lstrip(SPACE) for p, _ in pieces)
        self.by_lines = not any("\n" in p for p, _ in pieces)

    def search(self, word: str) -> tuple[float, int]:
        """Best score and piece count of one word, by one pass over the matches
        in the order of their ends, the longest of an end first."""
        unknown, fallback = self.unknown, self.fallback
        best, count, open_end = [0.0], [0], [False]
        at, top, pieces, single = 0, None, 0, False

        def close():  # the character at ``at`` may also stand alone, unknown
            nonlocal top, pieces
            unk = False
            if not single:
                s = best[at] + unknown
                if top is None or s > top:
                    top, unk = s, not fallback
                    pieces = count[at] + (len(word[at].encode("utf-8", "replace")) if fallback else not open_end[at])
            best.append(top)
            count.append(pieces)
            open_end.append(unk)

        for end, (length, score) in self.automaton.iter(word) if self.any else ():
            while at < end:
                close()
                at, top, single = at + 1, None, False
            s = best[end + 1 - length] + score
            if top is None or s > top:
                top, pieces = s, count[end + 1 - length] + 1
            if length == 1:
                single = True
        while at < len(word):
            close()
            at, top, single = at + 1, None, False
        return best[-1], count[-1]

    def known(self, word: str) -> tuple[float, int]:
        found = self.memory.get(word)
        if found is None:
            found = self.search(word)
            if len(word) <= REMEMBERED_CHARS:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = found
        return found

    def of(self, text: str) -> tuple[float, int]:
        if not self.by_words or not self.fallback:  # pieces, or runs of unknown characters, may cross words
            return self.search(text.replace(" ", SPACE)) if text else (0.0, 0)
        if not self.by_lines or "  " in text or SPACE in text:
            words = Counter(WORDS.findall(text.replace(" ", SPACE)))
        else:  # each word but the first of a line has one space before it
            words = Counter()
            first, *rest = text.replace("\n", " \n").split(" ")
            for w, k in Counter(rest).items():
                words[w if w[:1] == "\n" else SPACE + w] += k
            if first:
                words[first] += 1
        score, total = 0.0, 0
        for word, k in words.items():
            s, n = self.known(word)
            score, total = score + k * s, total + k * n
        return score, total


@lru_cache(maxsize=2)
def counter(path: str) -> Counts:
    """One for each Python worker: what it remembers serves the next task too."""
    return Counts(*load_pieces(path))


def counts(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, score) of every row of ``docs``. NULL and empty texts have
    0 pieces and score 0; repeated rows are counted each; other columns are not
    read; an empty table gives none. Spaces count as U+2581, nothing else is normalised."""
    path = path or _default_path()

    def run(batches):
        c = counter(path)

        def count(text):
            score, n = c.of(text)
            return n, score
        yield from each_text(batches, count, ["n_tokens", "score"], [pa.int64(), pa.float64()])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens bigint, score double")
