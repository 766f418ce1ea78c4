"""Substring deduplication by relative Lempel-Ziv parsing.

A bucket's runs are its reference block: the distinct runs of all documents around the bucket's
anchors, indexed by the places of their windows. Every run is parsed greedily, from left to right,
relative to what smaller documents have in the block: the factor at a place is the longest match
with one reference place. A factor of ``length`` words or more is a duplicate span. A factor ends
where its reference does, and a window that crosses its end may stand elsewhere, so the parse goes
on at each window that starts within the factor's last words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import common, repeats

WORDS = repeats.Shape("word", 50, 8)


def factors(ids: np.ndarray, begin: np.ndarray, text: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """Greedy factors (place, reference place, words) of all segments relative to smaller documents.

    Segments are put in the order of their documents. The block's index is its windows sorted by hash
    and document, so a window's first place in a smaller document is found at once; a factor is grown
    from there word by word on the texts themselves.
    """
    n = len(text)
    if n < length:
        return
    sums = repeats.Hashes(text)
    start = np.arange(n - length + 1)
    segment = np.searchsorted(begin, start, "right") - 1
    inside = start + length <= begin[segment + 1]
    start, segment = start[inside], segment[inside]
    code = sums.of(start, start + length)
    order = np.lexsort((start, ids[segment], code))
    fresh = np.ones(len(order), bool)
    fresh[1:] = code[order][1:] != code[order][:-1]
    head = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    source = np.full(n, -1)
    smaller = ids[segment[head]] < ids[segment[order]]
    source[start[order[smaller]]] = start[head[smaller]]
    ends = np.zeros(n, np.int64)
    ends[:] = np.repeat(begin[1:], np.diff(begin))
    # All segments are parsed side by side, one factor each per round.
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    found = np.flatnonzero(source >= 0)
    nxt = np.searchsorted(found, begin[:-1])
    live = np.flatnonzero((nxt < len(found)) & (np.append(found, n)[nxt] < begin[1:]))
    while len(live):
        place = found[nxt[live]]
        reference = source[place]
        room = np.minimum(ends[place] - place, ends[reference] - reference)
        size = np.full(len(live), length)
        grow = np.arange(len(live))
        while len(grow):
            grow = grow[size[grow] < room[grow]]
            grow = grow[text[place[grow] + size[grow]] == text[reference[grow] + size[grow]]]
            size[grow] += 1
        yield from zip(place.tolist(), reference.tolist(), size.tolist(), strict=True)
        # Windows within the factor are settled; the first that crosses its end is looked up next.
        nxt[live] = np.searchsorted(found, place + size - length + 1)
        live = live[(nxt[live] < len(found)) & (owner[np.append(found, 0)[nxt[live]]] == live)]


def parsed(ids: np.ndarray, begin: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """A flag per unit: a window that starts here stands in a smaller document."""
    edge = np.zeros(len(text) + 1, np.int32)
    for place, _, size in factors(ids, begin, text, length):
        edge[place] += 1
        edge[place + size - length + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        total, gone, kept = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [b""] * rows
        spans, copy = batch.column(3).to_pylist(), batch.column(2).to_pylist()
        for lo, hi, data, offsets in common.text_blocks(batch, 1):
            doc, start, end, _ = common.words(data, offsets)
            first = common.bounds_by_document(doc, hi - lo)
            for i in range(hi - lo):
                n = int(first[i + 1] - first[i])
                ranges = repeats.removed(spans[lo + i], copy[lo + i], n, length)
                stay = np.ones(n, bool)
                for a, b in ranges:
                    stay[a:b] = False
                total[lo + i], gone[lo + i] = n, n - stay.sum()
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                at = first[i] + np.flatnonzero(stay)
                kept[lo + i] = b" ".join([text[a:b] for a, b in zip((start[at] - offsets[i]).tolist(), (end[at] - offsets[i]).tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(gone), pa.array(kept, pa.binary()).cast(pa.string())], ["_id", "n_words", "n_removed", "kept"])
    common.give_back()


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shape: repeats.Shape = WORDS) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by a space).

    A word goes when a window of ``shape.length`` words covers it that also starts in a document
    with a smaller id. Null and empty texts have no words. A null id comes after all others; rows
    with one id do not count as smaller than each other, so repeated rows keep their words.
    """
    _, rows = repeats.repeated_windows(docs, id_col, text, shape, parsed)
    done = rows.select("_id", "_text", "_copy", "spans").mapInArrow(lambda b: _kept(b, shape.length), "_id bigint, n_words bigint, n_removed bigint, kept string")
    return done.select(F.nullif("_id", F.lit(repeats.NULL_ID)).cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept")
