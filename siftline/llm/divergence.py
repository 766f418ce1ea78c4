"""How far the sources of a language are apart in their use of words, in exact integers.

CountVectorizer (``minDF`` documents of the same language, no limit on the vocabulary) turns
documents into sparse vectors of counts; a term carries its language, so one fit serves all
languages. Texts are cut into terms once: tasks stage what the documents that they hold have of each
term, and later tasks merge some of these parts into the vectorizer's rows. For the fit, a term is
in as many rows as documents have it, ``minDF`` at most; for the vectors, a row lists terms that the
documents of a source have so many times, each once. The vectors' entries, times that number, are
summed per source, and pairs of sources are evaluated on the entries that are not zero: what two
sources differ by on the terms that neither has is one number.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import common

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes folded: A-Z to a-z, what is no part of a term to a space.
_FOLD_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms that one vectorizer may hold (its vocabulary is sent to the driver and to every task);
#: a corpus with more of them is vectorized in slices of the terms, each by a model of its own.
MODEL_TERMS = 4_000_000
#: One term in so many is counted beforehand, to know how many slices there must be.
PROBE = 64
#: Text bytes whose terms a task numbers at once.
FLUSH_BYTES = 8 << 20
#: Bytes of counts that a task merges before the vectorizer sees their terms.
HELD_BYTES = 48 << 20
#: Bytes of counts, as they were staged, that one later task reads.
TASK_BYTES = 80 << 20
#: Bytes of parts, compressed, that travel to Python together (a larger part goes alone).
TRAVEL = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
#: Bytes of terms in a row that the vectorizer gets, and entries whose rows travel together.
ROW_BYTES, AT_ONCE = 256 << 10, 1 << 18
#: Entries (source, term) that one task evaluates at once.
BLOCK_ENTRIES = 100_000
_END = "\x00"


def _numbered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(lang, source, text) to the document and the number of every term, and the distinct terms."""
    texts = batch.column(2).cast(pa.large_string()).cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    # Only ASCII parts terms, so texts can be folded and cut as bytes.
    data = _FOLD_BYTES[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = data != 32
    starts, stops = inside.copy(), inside.copy()
    edge = ends[:-1][ends[:-1] < len(data)]
    joins = edge[edge > 0]
    starts[1:] &= ~inside[:-1]
    starts[edge] = inside[edge]
    stops[:-1] &= ~inside[1:]
    stops[joins - 1] = inside[joins - 1]
    start = np.flatnonzero(starts)
    size = np.flatnonzero(stops) + 1 - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    found = terms.dictionary_encode()
    document = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, ends)))
    return document, found.indices.to_numpy(), found.dictionary.cast(pa.binary())


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``FLUSH_BYTES`` of text (a longer text goes alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for lo, hi, data, _ in common.text_blocks(batch, 2, FLUSH_BYTES):
            if held and size + len(data) > FLUSH_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(batch.slice(lo, hi - lo))
            size += len(data)
    if held:
        yield pa.concat_batches(held)


def _fronted(langs: pa.Array, lang: np.ndarray, terms: pa.Array, term: np.ndarray) -> pa.Array:
    """Terms with their language in front."""
    return pc.binary_join_element_wise(langs.cast(pa.binary()).take(pa.array(lang)), terms.take(pa.array(term)), _END.encode()).cast(pa.string())


class Counts(NamedTuple):
    """What documents have of the terms, an entry per (source of a language, term): occurrences, and documents that have it."""

    langs: pa.Array
    sources: pa.Array
    terms: pa.Array
    group: np.ndarray
    term: np.ndarray
    times: np.ndarray
    documents: np.ndarray

    def size(self) -> int:
        return sum(column.nbytes for column in self)

    def part(self) -> bytes:
        """All of it as an Arrow stream of one row."""
        columns = [pa.array(c) if isinstance(c, np.ndarray) else c for c in self]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        batch = pa.RecordBatch.from_arrays(lists, list(self._fields))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
            stream.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def of_part(cls, part: pa.Buffer) -> Counts:
        with pa.ipc.open_stream(part) as stream:
            columns = [column.flatten() for column in stream.read_next_batch().columns]
        return cls(*columns[:3], *[column.to_numpy() for column in columns[3:]])

    @classmethod
    def of_documents(cls, batch: pa.RecordBatch) -> Counts:
        """From (lang, source, text)."""
        document, number, terms = _numbered(batch)
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        pairs, group = np.unique(pair, return_inverse=True)
        width = max(len(terms), 1)
        code, times = np.unique(group[document] * width + number, return_counts=True)
        each = np.sort(document * width + number)
        each = each[np.diff(each, prepend=-1) > 0]
        documents = np.unique(group[each // width] * width + each % width, return_counts=True)[1]
        lang, source = np.divmod(pairs, len(sources.dictionary) or 1)
        names = langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source))
        return cls(*names, terms, (code // width).astype(np.int32), (code % width).astype(np.int32), times, documents)

    def asked(self) -> Counts:
        """One term in ``PROBE``."""
        few = (np.fromiter(map(zlib.crc32, self.terms.to_pylist()), np.uint32, len(self.terms)) % PROBE == 0)[self.term]
        return self._replace(group=self.group[few], term=self.term[few], times=self.times[few], documents=self.documents[few])

    def of_languages(self) -> Counts:
        """An entry per (language, term), as if a language had one source."""
        langs, width = self.langs.dictionary_encode(), max(len(self.terms), 1)
        code = langs.indices.to_numpy().astype(np.int64)[self.group] * width + self.term
        none = pa.array([""] * len(langs.dictionary), pa.string())
        return Counts(langs.dictionary, none, self.terms, *_summed(code, width, self.times, self.documents))


def _summed(code: np.ndarray, width: int, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, term, sums of the counts) of every code = group * width + term, in order."""
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    code = code[first]
    sums = [np.add.reduceat(n[order], first) if len(first) else n for n in counts]
    return (code // width).astype(np.int32), (code % width).astype(np.int32), *sums


def _together(held: list[Counts]) -> Counts:
    """One out of several, which the list then no longer holds."""
    if len(held) == 1:
        return held.pop()
    found = pa.concat_arrays([c.terms for c in held]).dictionary_encode()
    terms, numbers = found.dictionary, found.indices.to_numpy()
    names: dict[tuple[str, str], int] = {}
    at = 0
    for i, c in enumerate(held):
        group = np.array([names.setdefault(name, len(names)) for name in zip(c.langs.to_pylist(), c.sources.to_pylist(), strict=True)], np.int64)
        code = group[c.group] * len(terms) + numbers[at : at + len(c.terms)][c.term]
        at += len(c.terms)
        held[i] = code, c.times, c.documents
    code, times, documents = map(np.concatenate, zip(*held, strict=True))
    held.clear()
    langs, sources = (pa.array([name[i] for name in names], pa.string()) for i in (0, 1))
    return Counts(langs, sources, terms, *_summed(code, max(len(terms), 1), times, documents))


def _merges(batches: Iterator[pa.RecordBatch], kept: Callable[[Counts], Counts] | None = None) -> Iterator[Counts]:
    """Counts of about ``HELD_BYTES``, from documents (lang, source, text) or from counts of documents (part); of each what is ``kept``."""

    def each() -> Iterator[Counts]:
        held = iter(batches)
        for batch in held:
            if batch.schema.names[0] == "part":
                yield from (Counts.of_part(part.as_buffer()) for part in batch.column(0))
            else:
                yield from map(Counts.of_documents, _held(chain([batch], held)))

    held: list[Counts] = []
    size = 0
    for counts in each():
        counts = kept(counts) if kept else counts
        if held and size + counts.size() > HELD_BYTES:
            yield _together(held)
            size = 0
        held.append(counts)
        size += counts.size()
    if held:
        yield _together(held)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (part, size): counts of the documents, read again by ``_once`` and ``_merged``."""
    for counts in _merges(batches):
        yield pa.RecordBatch.from_arrays([pa.array([counts.part()], pa.binary()), pa.array([counts.size()], pa.int64())], ["part", "size"])
    common.give_back()


def _rows(tokens: pa.Array, fresh: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Tokens as rows that begin where ``fresh`` says and after ``ROW_BYTES`` or so: (the place of every row's first token, lists)."""
    size = np.cumsum(pc.binary_length(tokens).to_numpy() + 16)
    first = np.flatnonzero(fresh | (np.diff(size // ROW_BYTES, prepend=-1) != 0))
    return first, pa.ListArray.from_arrays(pa.array(np.append(first, len(tokens)).astype(np.int32)), tokens)


def _once(batches: Iterator[pa.RecordBatch], least: int, probe: bool) -> Iterator[pa.RecordBatch]:
    """Documents or parts to (tokens): every term in as many rows as documents of its language have it, ``least`` at most.

    A vectorizer that asks whether ``least`` rows have a term finds the same terms as in the documents:
    what ``least`` documents counted together have is kept whatever the others have.
    """
    for counts in _merges(batches, lambda c: (c.asked() if probe else c).of_languages()):
        for lo in range(0, len(counts.documents), AT_ONCE):
            group, term, n = (column[lo : lo + AT_ONCE] for column in (counts.group, counts.term, counts.documents))
            tokens = _fronted(counts.langs, group, counts.terms, term)
            for had in range(1, least + 1):
                yield pa.RecordBatch.from_arrays([_rows(tokens, np.zeros(len(tokens), bool))[1]], ["tokens"])
                more = n > had
                if not more.any():
                    break
                tokens, n = tokens.filter(pa.array(more)), n[more]
        del counts
    common.give_back()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents or parts to (lang, source, times, tokens): the terms that documents of the source have ``times`` times together."""
    for counts in _merges(batches):
        for lo in range(0, len(counts.times), AT_ONCE):
            group, term, times = (column[lo : lo + AT_ONCE] for column in (counts.group, counts.term, counts.times))
            by = np.lexsort((times, group))
            group, term, times = group[by], term[by], times[by]
            tokens = _fronted(counts.langs, group, counts.terms, term)
            first, lists = _rows(tokens, (np.diff(group, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
            names = [column.take(pa.array(group[first])) for column in (counts.langs, counts.sources)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(times[first]), lists], ["lang", "source", "times", "tokens"])
        del counts
    common.give_back()


def _in_slice(tokens: DataFrame, i: int, n: int) -> DataFrame:
    if n == 1:
        return tokens
    return tokens.withColumn("tokens", F.filter("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(n)) == i))


def _slices(probe: DataFrame, least: int) -> int:
    """Enough slices of the terms that a model stays below ``MODEL_TERMS``; from the distinct tokens probed."""
    kept = probe.select(F.explode("tokens").alias("t")).groupBy("t").count().filter(F.col("count") >= least).count()
    return common.parts(2 * PROBE * kept, MODEL_TERMS)


def _vectorized(parts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, counts) of ``term_counts`` from staged parts."""
    spark = parts.sparkSession
    once = parts.mapInArrow(lambda b: _once(b, least, False), "tokens array<string>")
    tokens = parts.mapInArrow(_merged, "lang string, source string, times long, tokens array<string>")
    slices = _slices(parts.mapInArrow(lambda b: _once(b, least, True), "tokens array<string>"), least)
    vocabulary = session.stage(spark.createDataFrame([], "index long, lang string, term string"), "vocabulary")
    counts = session.stage(spark.createDataFrame([], "index long, lang string, source string, n long"), "term-counts")
    base = 0
    for i in range(slices):
        maker = CountVectorizer(inputCol="tokens", outputCol="vector", minDF=float(least), vocabSize=2**31 - 1)
        try:
            fitted = maker.fit(_in_slice(once, i, slices))
        except IllegalArgumentException as error:  # the vectorizer refuses an empty vocabulary
            if "vocabulary size" not in str(error):
                raise
            continue
        names = fitted.vocabulary
        table = pa.table({"index": pa.array(np.arange(base, base + len(names))), "token": pa.array(names, pa.string())})
        token = F.col("token")
        cut = F.length(token) - F.length(F.substring_index(token, _END, -1))
        named = spark.createDataFrame(table).select("index", F.substring(token, F.lit(1), cut - 1).alias("lang"), F.substring_index(token, _END, -1).alias("term"))
        vocabulary = vocabulary.unionByName(session.stage(named, "vocabulary"))
        vector = fitted.transform(_in_slice(tokens, i, slices)).select("lang", "source", "times", F.unwrap_udt("vector").alias("v"))
        entries = vector.select("lang", "source", "times", F.inline(F.arrays_zip(F.col("v.indices").alias("i"), F.col("v.values").alias("x"))))
        sums = entries.groupBy("lang", "source", "i").agg(F.sum(F.col("times") * F.col("x").cast("long")).alias("n"))
        counts = counts.unionByName(session.stage(sums.select((F.col("i") + F.lit(base)).cast("long").alias("index"), "lang", "source", "n"), "term-counts"))
        base += len(names)
    return vocabulary, counts


def term_counts(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(vocabulary, counts): (index, lang, term) and (index, lang, source, n), n > 0, both staged.

    A term is kept when at least ``least`` documents of its language have it.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(common.text_of(lang).alias("lang"), common.text_of(source).alias("source"), common.text_of(text).alias("text"))
    staged = session.stage(rows.mapInArrow(_parts, "part binary, size long"), "term-parts")
    size = staged.agg(F.sum("size")).first()[0] or 0
    parts = staged.select("part").coalesce(common.parts(size, TASK_BYTES, spark.sparkContext.defaultParallelism))
    before = spark.conf.get(TRAVEL[0], None)
    spark.conf.set(*TRAVEL)
    try:
        return _vectorized(parts, least)
    finally:
        if before is None:
            spark.conf.unset(TRAVEL[0])
        else:
            spark.conf.set(TRAVEL[0], before)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)), by decimals that cannot overflow; null without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    below = F.nullif((total + SMOOTH * terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.call_function("div", above, below) + 1


def audit(docs: DataFrame, least: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    Part ``pair``: the other sources of the language by distance, all of them. Part ``term``: the
    ``top`` terms that the source has more often than its language has on the whole.
    Null texts, languages and sources count as ''. A group without terms, and a language of which no
    term is kept, have their pairs (at distance 0 then) and no terms; a lone source has no pairs. Ties go
    by UTF-8. Repeated rows count each; long texts are taken whole; an empty table gives no rows.
    Other columns of the input play no part. Runs jobs when called.
    """
    vocabulary, counts = term_counts(docs, least, text, lang, source)
    groups = docs.select(common.text_of(lang).alias("lang"), common.text_of(source).alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))
    known = groups.join(terms, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "total"])
    known = session.stage(known.withColumn("base", F.coalesce(_share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0))), "sources")
    shares = counts.join(known.select("lang", "source", "total", "terms"), ["lang", "source"])
    shares = session.stage(shares.select("lang", "source", "index", "n", "terms", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "shares")
    return _pairs(shares, known).unionByName(_terms(shares, vocabulary, top))


def _terms(shares: DataFrame, vocabulary: DataFrame, top: int) -> DataFrame:
    whole = shares.groupBy("index", "lang", "terms").agg(F.sum("n").alias("all_n"))
    sizes = whole.groupBy("lang").agg(F.sum("all_n").alias("all_total"))
    # What a language has of each of its terms.
    q = whole.join(sizes, "lang").select("index", _share(F.col("all_n"), F.col("all_total"), F.col("terms")).alias("q"))
    above = shares.join(q, "index").filter(F.col("p") > F.col("q")).join(vocabulary.select("index", "term"), "index")
    value = (F.col("p") - F.col("q")).alias("value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value)
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _pairs(shares: DataFrame, known: DataFrame) -> DataFrame:
    blocks = common.parts(shares.count(), BLOCK_ENTRIES)
    entries = shares.select("lang", F.pmod(F.xxhash64("index"), F.lit(blocks)).cast("int").alias("block"), "source", "index", "p")
    # Every block of a language also has all its sources, each with its share of a term it lacks.
    sources = known.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "source", F.lit(None).cast("long").alias("index"), F.col("base").alias("p"))
    each = entries.unionByName(sources).groupBy("lang", "block").applyInArrow(_block_pairs, "lang string, one string, other string, value long")
    sums = each.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))
    rows = sums.select("lang", F.inline(both), "value").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _block_pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of all pairs of sources over the terms of a block: its part of each pair's sum."""
    table = pa.Table.from_batches(batches).combine_chunks()
    lang = key[0].as_py()
    bare = table.column("index").is_null()
    sources = table.filter(bare)
    names = sources.column("source").combine_chunks()
    base = sources.column("p").to_numpy()
    rows = table.filter(pc.invert(bare))
    who = pc.index_in(rows.column("source").combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    for one, sums in block_distances(who, rows.column("index").to_numpy(), rows.column("p").to_numpy(), base):
        other = np.flatnonzero(np.arange(len(base)) != one)
        # Either source of a pair adds its part under the same key.
        low, high = names.take(pa.array(np.minimum(one, other))), names.take(pa.array(np.maximum(one, other)))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(other), pa.string()), low, high, pa.array(sums[other])], ["lang", "one", "other", "value"])


def block_distances(who: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each source g, numbers x[h]; over a block's terms, the distance of g and h is x_g[h] + x_h[g].

    Entries (who, term, p) are the shares of terms that a source has; ``base`` is a source's share of
    any other. A term that only g has adds |p - base_h| in place of |base_g - base_h|; one that both
    have is put right where the two meet. Work follows the entries, not sources times terms.
    """
    order = np.lexsort((who, term))
    who, term, p = who[order], term[order], p[order]
    edges = np.flatnonzero(np.diff(term, prepend=-1)) if len(term) else np.zeros(0, np.int64)
    sizes = np.diff(edges, append=len(term))
    of_term = np.repeat(np.arange(len(edges)), sizes)
    by_source = np.argsort(who, kind="stable")
    bounds = np.searchsorted(who[by_source], np.arange(len(base) + 1))
    for g in range(len(base)):
        mine = by_source[bounds[g] : bounds[g + 1]]
        own = np.sort(p[mine])
        sums = np.concatenate([[0], np.cumsum(own)])
        at = np.searchsorted(own, base)
        apart = np.abs(base[g] - base)
        # Sum over own terms of |p - base_h|, less what the base shares alone would give.
        out = sums[-1] - 2 * sums[at] + (2 * at - len(own)) * base - len(own) * apart
        # The terms that no source of the pair has: counted once, by the first of the two.
        out += np.where(np.arange(len(base)) > g, len(edges) * apart, 0)
        # Where both have the term; the later source of a pair leaves it to the first.
        count = sizes[of_term[mine]] - 1 - (mine - edges[of_term[mine]])
        if count.sum():
            total = np.cumsum(count)
            partner = np.repeat(mine + 1 - (total - count), count) + np.arange(int(total[-1]))
            a, b, h = np.repeat(p[mine], count), p[partner], who[partner]
            fix = np.abs(a - b) - np.abs(a - base[h]) - np.abs(base[g] - b) + apart[h]
            place = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.diff(h[place], prepend=-1))
            out[h[place][first]] += np.add.reduceat(fix[place], first)
        yield g, out
