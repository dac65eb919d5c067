"""Passages that occur more than once, removed word by word.

A window is LENGTH consecutive words. Each window is routed by its least word-gram hash (its minimizer), so equal
windows meet in one shard and a run of neighbouring windows with one minimizer travels as one segment. Only segments
whose minimizer occurs twice or more travel at all, and equal segments become one with a count before they are dealt;
a minimizer with very many segments is dealt to several shards, window by window.
Every shard holds an FM-index of its segments: a wavelet matrix of bit vectors with block ranks over the words'
Burrows-Wheeler transform. Backward search of the streamed segments gives the matching statistics of their windows (how
far each is found at least twice, at most LENGTH words), and the windows found whole are reported as word intervals.
Equal words are told by the words; a found interval goes back to its documents by its segment's minimizer and MD5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import discard, documents, written

LENGTH, GRAM = 35, 12
#: Words of one index; a shard with more is indexed in pieces, cut between minimizers.
INDEX_WORDS = 1 << 20
#: Bytes of one minimizer's segments beyond which these are dealt to several shards: about what one index holds.
HOT_BYTES = 8 * INDEX_WORDS
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _words(text: str | bytes | None) -> list[bytes]:
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """Hash of each run of `gram` words, by prefix sums of a polynomial modulo 2^64."""
    h = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    power = np.ones(len(h) + 1, np.uint64)
    power[1:] = _U(_BASE)
    power = np.multiply.accumulate(power)
    inverse = np.ones(len(h) + 1, np.uint64)
    inverse[1:] = _U(pow(_BASE, -1, 1 << 64))
    inverse = np.multiply.accumulate(inverse)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=total[1:])
    return _mix((total[gram:] - total[:-gram]) * inverse[: len(h) - gram + 1])


def runs(words: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows, places of the minimizer in the document) of each run of windows with one minimizer."""
    if len(words) < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    g = _gram_hashes(words, gram)
    span = length - gram + 1
    low, width = g, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(g) - span + 1], low[span - width :])
    start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    count = np.diff(np.r_[start, len(low)])
    m = low[start]
    # A window can equal another one of its own run only where the document has two places of the minimizer.
    ordered = np.sort(g)
    places = np.searchsorted(ordered, m, "right") - np.searchsorted(ordered, m, "left")
    return m, start, count, places


class FMIndex:
    """Counts of patterns of at most `length` words in weighted segments."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, length: int):
        """ids: words as numbers from 1, with 0 after each segment; weight: of each position's segment."""
        n = len(ids)
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        width, most = 1, int(rank.max(initial=0)) + 2
        while True:
            #: Words of a seed, and by place the number of its seed among all in order.
            self.seed, seeds = width, rank
            # Three ranks make one key of 63 bits where they fit, else two.
            several = 3 if most < 1 << 21 else 2
            key = rank.copy()
            for k in range(1, several):
                key *= most
                key[: max(0, n - k * width)] += rank[k * width :] + 1
            order = np.argsort(key, kind="stable")
            s = key[order]
            width *= several
            new = np.r_[0, s[1:] != s[:-1]].cumsum()
            if width >= length or new[-1] == n - 1:
                break
            rank = np.empty(n, np.int64)
            rank[order] = new
            most = int(new[-1]) + 2
        # Suffixes are in the order of their first `width` words, which is all that patterns of `length` need. Those with
        # one seed are neighbours: a search starts from their interval, as from a table of all seeds.
        self.seeds, self.bounds = seeds, np.r_[0, np.cumsum(np.bincount(seeds))]
        self.weights = np.r_[0, np.cumsum(weight[order])]
        bwt = ids[order - 1]
        self.n = n
        self.first = np.r_[0, np.cumsum(np.bincount(ids, minlength=int(ids.max()) + 2))]
        self.levels = []
        for bit in reversed(range(int(ids.max()).bit_length())):
            b = (bwt >> bit) & 1
            packed = np.packbits(b.astype(np.uint8), bitorder="little")
            packed = np.r_[packed, np.zeros(8 + -len(packed) % 8, np.uint8)].view(np.uint64)
            blocks = np.r_[0, np.cumsum(np.bitwise_count(packed).astype(np.int64))].astype(np.int32)
            zeros = n - int(b.sum())
            self.levels.append((bit, packed, blocks, zeros))
            bwt = np.concatenate([bwt[b == 0], bwt[b == 1]])

    def _rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often word c stands in the first i places of the transform, by the wavelet matrix."""
        start = np.zeros(len(c), np.int64)
        for bit, packed, blocks, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            for x in (start, i):
                block = x >> 6
                ones = blocks[block] + np.bitwise_count(packed[block] & ((_U(1) << (x & 63).astype(np.uint64)) - _U(1)))
                x[:] = np.where(one, zeros + ones, x - ones)
        return i - start

    def matched(self, ids: np.ndarray, ends: np.ndarray, length: int, least: int = 2) -> np.ndarray:
        """Matching statistics: for each end (exclusive) the words before it, at most `length`, that occur with weight `least` or more; 0 below a seed."""
        got = np.zeros(len(ends), np.int64)
        seeds = self.seeds[ends - self.seed]
        lo, hi = self.bounds[seeds], self.bounds[seeds + 1]
        live = np.flatnonzero(self.weights[hi] - self.weights[lo] >= least)
        lo, hi = lo[live], hi[live]
        got[live] = self.seed
        for step in range(self.seed + 1, length + 1):
            c = ids[ends[live] - step]
            lo = self.first[c] + self._rank(c, lo.copy())
            hi = self.first[c] + self._rank(c, hi.copy())
            ok = self.weights[hi] - self.weights[lo] >= least
            live, lo, hi = live[ok], lo[ok], hi[ok]
            got[live] = step
            if not len(live):
                break
        return got


def repeated_windows(segments: list[list[bytes]], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the windows (by first word) that occur twice or more in all of them, counts included."""
    flat = list(chain.from_iterable([*s, b""] for s in segments))
    names = {w: k for k, w in enumerate(dict.fromkeys(flat), 1)}
    ids = np.fromiter(map(names.__getitem__, flat), np.int64, len(flat))
    sizes = np.array([len(s) + 1 for s in segments])
    ends = np.cumsum(sizes)
    ids[ends - 1] = 0
    index = FMIndex(ids, np.repeat(np.array(counts, np.int64), sizes), length)
    at = [e - n + np.arange(length, n) for e, n in zip(ends, sizes, strict=True)]
    got = index.matched(ids, np.concatenate(at), length)
    return [np.flatnonzero(g == length) for g in np.split(got, np.cumsum([len(a) for a in at])[:-1])]


def _intervals(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal word intervals that the windows cover."""
    if not len(windows):
        return []
    cut = np.flatnonzero(windows[1:] > windows[:-1] + length) + 1
    first, last = windows[np.r_[0, cut]], windows[np.r_[cut - 1, len(windows) - 1]]
    return [(int(a), int(b) + length) for a, b in zip(first, last, strict=True)]


def _doc_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            found = [runs(_words(t.as_py())) for t in part.column(2)]
            row = np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found])
            m, start, count, places = (np.concatenate([f[i] for f in found]) for i in range(4))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(m.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(places.astype(np.int32))], names=["doc_id", "k", "m", "start", "windows", "places"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            words = _words(b.column(2)[r].as_py())
            found = b.column(3)[r].as_py()
            cut = [b" ".join(words[x["start"] : x["start"] + x["windows"] + LENGTH - 1]) for x in found]
            place = pa.array(np.full(len(found), r))
            yield pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(1).take(place), pa.array([x["start"] for x in found], pa.int32()), pa.array([x["m"] for x in found], pa.int64()), pa.array(cut, pa.binary())], names=["doc_id", "k", "start", "m", "words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (m, parts, words, c, s) of a hot minimizer as rows (m, parts, s, at, window, c), one for each window."""
    for b in batches:
        for m, parts, words, c, s in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            w = words.split(b" ")
            cut = [b" ".join(w[k : k + LENGTH]) for k in range(len(w) - LENGTH + 1)]
            same = lambda v, t, n=len(cut): pa.array([v] * n, t)
            yield pa.RecordBatch.from_arrays([same(m, pa.int64()), same(parts, pa.int32()), same(s, pa.binary()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary()), same(c, pa.int64())], names=["m", "parts", "s", "at", "window", "c"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, part, words, c, s), sorted by m and part. Gives (m, part, s, intervals in the words)."""
    held: list[tuple[int, int, bytes, int, bytes]] = []
    size = 0

    def give(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = repeated_windows([r[2].split() for r in rows], [r[3] for r in rows])
        kept = [(r[0], r[1], r[4], _intervals(w, LENGTH)) for r, w in zip(rows, found, strict=True) if len(w)]
        for k in range(0, len(kept), 4096):
            m, part, s, iv = zip(*kept[k : k + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(part, pa.int32()), pa.array(s, pa.binary()), pa.array([[{"a": a, "b": b} for a, b in x] for x in iv], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["m", "part", "s", "spans"])

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if size >= INDEX_WORDS and held[-1][:2] != row[:2]:
                yield from give(held)
                held, size = [], 0
            held.append(row)
            size += row[2].count(b" ") + 2
    if held:
        yield from give(held)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, sha = [], [], []
        for t, spans in zip(b.column(1), b.column(2), strict=True):
            words, spans = _words(t.as_py()), spans.as_py()
            n.append(len(words))
            if spans:
                keep = np.ones(len(words), bool)
                for s in spans:
                    keep[s["a"] : s["b"]] = False
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            gone.append(n[-1] - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # k tells the texts of one doc_id apart.
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k, spans): word intervals of each document that repeated windows cover; documents without any are missing."""
    rows = _keyed(docs, id_col, text_col)
    key = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, k long"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = written(rows.select("doc_id", "k", "text").mapInArrow(_doc_runs, f"{key}, m long, start int, windows int, places int"), "runs")
    often = slim.groupBy("m").agg(F.sum("places").alias("c")).where("c > 1").select("m")
    again = slim.join(often, "m", "left_semi")
    lists = again.groupBy("doc_id", "k").agg(F.collect_set(F.struct("m", "start", "windows")).alias("runs"))
    t, x = rows.alias("t"), lists.alias("x")
    same = F.col("t.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("t.k") == F.col("x.k"))
    holding = t.join(x, same).select("t.doc_id", "t.k", "t.text", "x.runs")
    segments = written(holding.mapInArrow(_segments, f"{key}, start int, m long, words binary"), "segments")
    discard(slim)
    name = F.unhex(F.md5("words")).alias("s")
    distinct = lambda df, *more: df.groupBy("m", *more, "words").agg(F.count(F.lit(1)).alias("c"))
    # A minimizer whose segments are more than an index holds is dealt window by window.
    sizes = segments.groupBy("m").agg(F.sum(F.length("words")).alias("bytes")).where(F.col("bytes") > HOT_BYTES)
    hot = written(sizes.select("m", F.ceil(F.col("bytes") * LENGTH / HOT_BYTES).cast("int").alias("parts")), "hot-minimizers")
    whole = lambda df: distinct(df).select("m", F.lit(0).alias("part"), "words", "c", name)
    found_in = "m long, part int, s binary, spans array<struct<a:int,b:int>>"
    search = lambda df: df.repartition(parts, "m", "part").sortWithinPartitions("m", "part").mapInArrow(_search, found_in)
    if hot.isEmpty():
        found = search(whole(segments)).select("m", "s", "spans")
    else:
        apart = distinct(segments.join(hot, "m"), "parts").select("m", "parts", "words", "c", name).mapInArrow(_windows, "m long, parts int, s binary, at int, window binary, c long")
        # Equal windows become one with their count before they are dealt.
        one = apart.groupBy("m", "parts", "window").agg(F.sum("c").alias("c"))
        one = one.select("m", (1 + F.pmod(F.xxhash64("window"), F.col("parts"))).cast("int").alias("part"), F.col("window").alias("words"), "c", F.unhex(F.md5("window")).alias("s"))
        found = written(search(whole(segments.join(hot, "m", "left_anti")).unionByName(one)), "found")
        again = apart.select("m", "s", "at", F.unhex(F.md5("window")).alias("w")).join(found.where("part > 0").select("m", F.col("s").alias("w")), ["m", "w"])
        spans = F.transform(F.collect_set("at"), lambda x: F.struct(x.alias("a"), (x + LENGTH).alias("b")))
        found = found.where("part = 0").select("m", "s", "spans").unionByName(again.groupBy("m", "s").agg(spans.alias("spans")))
    hits = segments.select("doc_id", "k", "start", "m", name).join(found, ["m", "s"])
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    return hits.select("doc_id", "k", F.explode(moved).alias("s")).groupBy("doc_id", "k").agg(F.collect_set("s").alias("spans"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Null and empty texts, and texts of fewer words than a window, lose nothing. Repeated rows count as other places of
    each other's windows. Very long and periodic texts are handled as any other. An empty table gives an empty result;
    other columns are not read.
    """
    rows = _keyed(docs, id_col, text_col)
    t, x = rows.alias("t"), repeated_spans(docs, id_col, text_col).alias("x")
    same = F.col("t.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("t.k") == F.col("x.k"))
    both = t.join(x, same, "left").select("t.doc_id", "t.text", "x.spans")
    return both.mapInArrow(_kept, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """remove_repeated on all documents; nulls, empty and repeated rows as there."""
    return remove_repeated(documents(spark, sf_dir))
