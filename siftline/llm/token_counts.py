"""Token counts of a unigram tokenizer, by a Viterbi search that only counts.

An Aho-Corasick automaton of the vocabulary enumerates all pieces in a pre-token, in one pass. The
dynamic programme carries, for every place, the best score and the number of tokens of the path
that has it; no path is kept. Ties follow the tokenizer: among equal scores the path whose last
piece starts first stays. A character that no one-character piece matches can be taken as unknown
for the least score of the vocabulary less a penalty; unknown characters fall back to their bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import common

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Pre-tokens that a worker remembers with their counts; the memory starts anew when it is full.
REMEMBERED = 200_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message: ints, floats and bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            yield tag >> 3, data[at : at + 8]
            at += 8


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of all pieces of a model file, in the order of their ids."""
    with open(path, "rb") as file:
        data = file.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode("utf-8"), float(piece.get(2, 0.0))))
    return out


class Counter(dict):
    """Counts of pre-tokens; a missing one is counted when it is asked for."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        known = {p for p, _ in pieces}
        #: Whether every byte has a piece of its own; else a run of unknown characters is one token.
        self.by_bytes = all(f"<0x{b:02X}>" in known for b in range(256))

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.count(word)
        return out

    def count(self, word: str) -> int:
        n = len(word)
        best, tokens, fused = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(word)
        match = next(matches, None)
        for end in range(1, n + 1):
            top = None
            single = unknown = False
            # At one end, matches come from the longest to the shortest, that is by their start.
            while match is not None and match[0] == end - 1:
                size, score = match[1]
                value = best[end - size] + score
                if top is None or value > top:
                    top, pieces = value, tokens[end - size] + 1
                single = size == 1
                match = next(matches, None)
            if not single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, unknown = value, True
                    more = len(word[end - 1].encode("utf-8")) if self.by_bytes else not fused[end - 1]
                    pieces = tokens[end - 1] + more
            best[end], tokens[end], fused[end] = top, pieces, unknown
        return tokens[n]

    def count_text(self, text: str) -> int:
        """Spaces become the mark that begins a pre-token; a text that has none in front gets one."""
        if not text:
            return 0
        parts = text.replace(SPACE, " ").split(" ")
        if not parts[0]:
            parts = parts[1:]
        return sum(self[SPACE + part] for part in parts)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(read_pieces(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """The rows with the number of tokens of their text; 0 for a null or empty one.

    Whole texts of any length; nothing is shuffled. A column called like ``out`` is replaced.
    """
    common.ship(docs.sparkSession)

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path).count_text
        for batch in batches:
            yield pa.array([count(one.as_py()) for one in batch], pa.int64())
        common.give_back()

    return docs.withColumn(out, F.arrow_udf(column, "bigint")(common.text_of(text)))
