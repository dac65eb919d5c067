"""SimHash near-duplicates found through Golay-code keys.

A fingerprint's bit is set where more than half of the hashes of its word shingles have it. Fingerprints of 64 bits
that differ in at most three bits are linked. Keys come from four blocks of 16 bits: one block is taken as it is
(three errors spare one of four blocks) and the 23 bits that follow it, cyclically, are decoded to the nearby codewords
of the perfect Golay code [23, 12, 7]: the nearest one, and those at distance 4 where the nearest is at distance 3.
Two 23-bit words that differ in at most two bits share such a codeword. If all three errors lie in the decoded bits of
one block's key, another error-free block follows whose decoded bits hold at most two of them; so every linked pair
shares at least one of about 21 keys of 28 bits. Buckets of equal keys are verified bit by bit; a bucket gives a
spanning forest of its links rather than all its pairs. Only distinct fingerprints take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from xxhash import xxh64_intdigest

from tidemark.llm.common import components, discard, documents, private, written

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Rows of one bucket that a task holds together; a larger bucket is split.
BUCKET = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; zero for a text without words. Fewer words than a shingle: the whole sequence is the only shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    w = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        w ^= np.where((w >> bit) & 1, GOLAY << (bit - 11), 0)
    return w


def _coset_table() -> np.ndarray:
    """(2048, 6) error patterns that lead from a word with this syndrome to its nearby codewords; unused ones are -1."""
    single = _syndromes(1 << np.arange(23))
    found: list[list[int]] = [[] for _ in range(2048)]
    level = [(0, 0, -1)]
    for weight in range(5):
        for pattern, syndrome, _ in level:
            near = found[syndrome]
            if weight <= 3 or (near and bin(near[0]).count("1") == 3):
                near.append(pattern)
        level = [(p | 1 << b, int(s ^ single[b]), b) for p, s, last in level for b in range(last + 1, 23)]
    return np.array([x + [-1] * (6 - len(x)) for x in found], dtype=np.int64)


_TABLE: np.ndarray | None = None


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices, 12 bits each, of the codewords near 23-bit words; unused ones are -1."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _coset_table()
    patterns = _TABLE[_syndromes(words)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of the fingerprint) for all keys of unsigned 64-bit fingerprints."""
    keys, places = [], []
    for i in range(4):
        turned = (fps >> np.uint64(16 * i)) | (fps << np.uint64((64 - 16 * i) % 64)) if i else fps
        block = (turned & np.uint64(0xFFFF)).astype(np.int64)
        codes = golay_keys(((turned >> np.uint64(16)) & np.uint64((1 << 23) - 1)).astype(np.int64))
        row, _ = np.nonzero(codes >= 0)
        keys.append((i << 28) | (block[row] << 12) | codes[codes >= 0])
        places.append(row)
    return np.concatenate(keys), np.concatenate(places)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        key, row = keys_of(fps)
        own = pa.array(fps[row].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(key), own, own], names=["key", "node", "fp"])


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one 64-bit word or, in rows, of several."""
    d = np.bitwise_count(a ^ b)
    return d if d.ndim < 2 else d.sum(1, dtype=np.int64)


def link_bucket(fps: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Places of links that connect exactly what all links of at most `most` bits in this bucket connect.

    Members are dealt to stars around pivots. Two stars can only touch where their pivots differ in at most 3 * most
    bits; those are compared member by member, and only until they are one.
    """
    n, links = len(fps), []
    star, pivots = np.full(n, -1), []
    top: list[int] = []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for p in range(n):
        if star[p] >= 0:
            continue
        s = len(pivots)
        pivots.append(p)
        top.append(s)
        near = np.flatnonzero(_differ(fps, fps[p : p + 1] if fps.ndim > 1 else fps[p]) <= most)
        for x in near[star[near] >= 0]:
            if (r := root(int(star[x]))) != root(s):
                top[root(s)] = r
                links.append((p, int(x)))
        new = near[star[near] < 0]
        star[new] = s
        links += [(p, int(x)) for x in new if x != p]
    if len(pivots) == 1:
        return links
    heads = fps[pivots]
    order = np.argsort(star, kind="stable")
    ends = np.cumsum(np.bincount(star, minlength=len(pivots)))
    member = lambda s: order[ends[s - 1] if s else 0 : ends[s]]
    for s in range(len(pivots)):
        for t in np.flatnonzero(_differ(heads[:s], heads[s : s + 1] if fps.ndim > 1 else heads[s]) <= 3 * most):
            if root(s) == root(int(t)):
                continue
            mine, theirs = member(s), member(int(t))
            for x in mine:
                hit = np.flatnonzero(_differ(fps[theirs], fps[x : x + 1] if fps.ndim > 1 else fps[x]) <= most)
                if len(hit):
                    top[root(s)] = root(int(t))
                    links.append((int(x), int(theirs[hit[0]])))
                    break
    return links


def _links_of(key: np.ndarray, fp: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, node) in whole buckets, rows sorted by key and node: a group's links lead to its smallest nodes in every bucket, so buckets repeat them."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    bucket = np.repeat(np.arange(len(starts)), sizes)
    few = np.repeat(sizes <= 32, sizes)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(sizes[sizes <= 32].max(initial=1))):
        x = np.flatnonzero((bucket[d:] == bucket[:-d]) & few[d:])
        x = x[_differ(fp[x], fp[x + d]) <= most]
        a.append(x)
        b.append(x + d)
    a, b = _forest(np.concatenate(a), np.concatenate(b))
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        links = s + np.array(link_bucket(fp[s : s + n], most), dtype=np.int64).reshape(-1, 2)
        a, b = np.r_[a, links[:, 0]], np.r_[b, links[:, 1]]
    return node[a], node[b]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between places a < b those that a spanning forest needs, from each group's first places outward."""
    order = np.lexsort((b, a))
    top: dict[int, int] = {}
    kept = []

    def root(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = x = top.get(y, y)
        return x

    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            top[max(x, y)] = min(x, y)
            kept.append(i)
    return a[kept], b[kept]


def _bucket_links(most: int):
    """Rows (key, node, one or more words of the fingerprint) arrive sorted by key; a bucket that a batch leaves open waits for the next one."""

    def give(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _links_of(key, fp, node, most)
        ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        ab = ab[ab[:, 0] != ab[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, *fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            fp = [x.view(np.uint64) for x in fp]
            held.append((key, node, fp[0] if len(fp) == 1 else np.stack(fp, 1)))
            if held[0][0][0] == key[-1]:
                continue
            key, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            held = [(key[cut:], node[cut:], fp[cut:])]
            yield give(key[:cut], node[:cut], fp[:cut])
        if held:
            yield give(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links of at most MAX_BITS bits that connect the distinct fingerprints in column fp (signed 64-bit)."""
    return _linked(fps.select("fp").mapInArrow(_keys, "key long, node long, fp long"), MAX_BITS)


def _linked(rows: DataFrame, most: int) -> DataFrame:
    """Links of buckets; a bucket of more than BUCKET rows is dealt to pairs of blocks, so that no task holds it whole."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = rows.groupBy("key").count().where(F.col("count") > BUCKET).select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("blocks"))
    hot = written(hot, "hot-buckets")
    split = rows.withColumn("part", F.lit(0))
    if not hot.isEmpty():
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        # Every two blocks meet in one part, numbered by the larger and the smaller of them.
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.greatest(mine, o) * F.col("blocks") + F.least(mine, o))
        split = rows.join(hot, "key", "left").withColumn("part", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pair)))
    # A part is a bucket of its own: its key is the bucket's with the part's number mixed in; equal values only add comparisons.
    split = split.select(F.when(F.col("part") == 0, F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"), "node", "fp")
    return split.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_bucket_links(most), "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(shingle), docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("fp")).schema)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts, and texts without words, have fingerprint zero, linked like any other. Repeated rows each get
    a row. A null doc_id is larger than any other, so it never names a component that has another member. An empty
    table gives an empty result; other columns are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    comp = components(fingerprint_links(distinct), name="simhash-components")
    node = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = node.groupBy("component").agg(F.min("least").alias("component_id"))
    named = node.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicate texts: the sets of their five-word shingles have a Jaccard index of 4/5 or more.
NEAR_SHINGLE, NEAR_SHARE = 5, (4, 5)
#: Bands of a set's minhashes and minhashes of a band. Two sets at 4/5 agree in no band with a chance of (1 - 0.8^4)^40 = 7e-10.
NEAR_BANDS, NEAR_HASHES = 40, 4
#: Buckets up to this size give all pairs; larger ones are compared set by set, in blocks of about this many shingles.
NEAR_SMALL, NEAR_BLOCK = 6, 1 << 20
#: Members of a bucket of several blocks, about, that stand in all of them.
NEAR_PIVOTS = 16
#: Rows that a batch holds before it goes out.
NEAR_ROWS = 1 << 16
#: Odd multipliers, one for each minhash, from a splitmix sequence.
_SPLIT = np.arange(1, NEAR_BANDS * NEAR_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SPLIT = (_SPLIT ^ (_SPLIT >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
_MULTIPLY = (_SPLIT ^ (_SPLIT >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)


def near_shingles(text: str | None) -> set[bytes]:
    """Distinct shingles; fewer words than a shingle are one, a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < NEAR_SHINGLE:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(NEAR_SHINGLE)), strict=False)))


def is_near(a: set[bytes], b: set[bytes]) -> bool:
    up, down = NEAR_SHARE
    both = len(a & b)
    return both > 0 and down * both >= up * (len(a) + len(b) - both)


def near_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted."""
    grams = near_shingles(text)
    return np.unique(np.fromiter(map(xxh64_intdigest, grams), np.uint64, len(grams)))


def near_bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of the minhashes of a set that isn't empty."""
    low = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 512):
        np.minimum(low, (hashes[k : k + 512, None] * _MULTIPLY).min(0), out=low)
    rows = low.reshape(NEAR_BANDS, NEAR_HASHES)
    key = np.arange(1, NEAR_BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(NEAR_HASHES):
        key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, size) for each band of each text with words; size: distinct shingles."""
    rows: list[tuple[int, np.ndarray, int]] = []

    def give() -> pa.RecordBatch:
        node, size = (np.repeat(np.array([r[k] for r in rows], np.int64), NEAR_BANDS) for k in (0, 2))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[1] for r in rows])), pa.array(node), pa.array(size)], names=["key", "node", "size"])

    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            if i.is_valid and len(h := near_hashes(t.as_py())):
                rows.append((i.as_py(), near_bands(h), len(h)))
            if len(rows) * NEAR_BANDS >= NEAR_ROWS:
                yield give()
                rows = []
    if rows:
        yield give()


def _near_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([near_hashes(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], names=["node", "hashes"])


def _whole_buckets(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows of one value of the first `keys` columns at a time; they arrive sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = last is not None and first != last
        cuts = sorted({0, *np.flatnonzero(new).tolist(), b.num_rows})
        for s, e in pairwise(cuts):
            if new[s] and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(s, e - s))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _small_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (a, b) of small buckets whose sizes allow it; rows (key, node, size) arrive sorted by key and node."""
    up, down = NEAR_SHARE
    tail = [np.zeros(0, np.int64)] * 3
    for b in batches:
        key, node, size = (np.r_[t, b.column(k).to_numpy(zero_copy_only=False)] for k, t in enumerate(tail))
        a, c = [], []
        for d in range(1, NEAR_SMALL):
            # A pair goes out with the batch that its second row came with.
            x = np.flatnonzero(key[d:] == key[:-d])
            x = x[x + d >= len(tail[0])]
            x = x[(node[x] != node[x + d]) & (down * np.minimum(size[x], size[x + d]) >= up * np.maximum(size[x], size[x + d]))]
            a.append(node[x])
            c.append(node[x + d])
        a, c = np.concatenate(a), np.concatenate(c)
        ab = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])
        tail = [key[-NEAR_SMALL:], node[-NEAR_SMALL:], size[-NEAR_SMALL:]]


def link_sets(sets: list[np.ndarray], group: np.ndarray) -> list[tuple[int, int]]:
    """Places of near sets that connect, with what `group` has connected, exactly what all near pairs connect.

    Sets that no star holds yet become pivots and are compared with all others, by postings of the hashes that several
    sets have. Then sets outside the largest group are compared too: of two sets in different groups one is.
    """
    m, (up, down) = len(sets), NEAR_SHARE
    size = np.fromiter(map(len, sets), np.int64, m)
    u, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[at] > 1
    owner, at = np.repeat(np.arange(m), size)[several], at[several]
    post = owner[np.argsort(at, kind="stable")]
    start = np.r_[0, np.cumsum(np.bincount(at, minlength=len(u)))]
    bound = np.searchsorted(owner, np.arange(m + 1))
    top, links = np.unique(group, return_index=True, return_inverse=True)[1:], []
    top = top[0][top[1]].tolist()  # the first of each group

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    def meet(x: int) -> np.ndarray:
        mine = at[bound[x] : bound[x + 1]]
        each = start[mine + 1] - start[mine]
        both = np.bincount(post[np.repeat(start[mine] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())], minlength=m) if len(mine) else np.zeros(m, np.int64)
        near = np.flatnonzero((both > 0) & (down * both >= up * (size[x] + size - both)))
        for y in near.tolist():
            a, b = root(x), root(y)
            if a != b:
                top[max(a, b)] = min(a, b)
                links.append((x, y))
        return near

    held = np.array([root(x) for x in range(m)]) != np.arange(m)  # a group's first member is still to be compared
    done = np.zeros(m, bool)
    for x in range(m):
        if not held[x]:
            held[meet(x)] = True
            done[x] = True
    roots = np.array([root(x) for x in range(m)])
    name, count = np.unique(roots, return_counts=True)
    for x in np.flatnonzero((roots != name[count.argmax()]) & ~done).tolist():
        meet(x)
    return links


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (key, part, node, component, hashes), sorted by key, part and node."""
    for b in _whole_buckets(batches, 2):
        node = b.column(2).to_numpy()
        sets = [np.frombuffer(h.as_py(), np.uint64) for h in b.column(4)]
        links = np.array(link_sets(sets, b.column(3).to_numpy()), np.int64).reshape(-1, 2)
        ab = np.sort(node[links], axis=1)
        ab = ab[ab[:, 0] != ab[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text of a, text of b), by a, those whose texts are near duplicates."""
    text, own = None, set()
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            if (x := x.as_py()) != text:
                text, own = x, near_shingles(x)
            keep.append(is_near(own, near_shingles(y.as_py())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _near_pairs(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b), a table already, whose texts are near duplicates."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = written(ids.where("text is not null").join(needed, "node", "left_semi"), "near-texts")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    links = written(both.select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long"), "near-links")
    discard(texts)
    return links


def _golay_pairs(ids: DataFrame) -> DataFrame:
    """Pairs (a, b) whose fingerprints of five-word shingles link, one for each fingerprint and link of fingerprints."""
    rows = written(fingerprints(ids, "node", "text", NEAR_SHINGLE).where("fp <> 0 and doc_id is not null"), "near-fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "near-distinct")
    links = fingerprint_links(distinct)
    x, y = (distinct.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_least")) for c in "ab")
    linked = links.join(x, "a").join(y, "b").select(F.least("a_least", "b_least").alias("a"), F.greatest("a_least", "b_least").alias("b"))
    same = rows.join(distinct, "fp").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    pairs = written(linked.unionByName(same).where("a <> b"), "near-golay")
    discard(rows, distinct)
    return pairs


def _large_links(large: DataFrame, ids: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) that, with those found, connect what near sets in large buckets connect; large: rows (key, node, size), a table.

    A bucket is dealt to blocks by hash, a few pivots to all of them. Where a bucket has several blocks, members that
    its main component hasn't got after that are compared with every block.
    """
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = written(ids.join(large.select("node").distinct(), "node", "left_semi").mapInArrow(_near_sets, "node long, hashes binary"), "near-sets")
    schema = "a long, b long"

    def run(rows: DataFrame, name: str) -> DataFrame:
        with_sets = rows.join(sets, "node").select("key", "part", "node", "component", "hashes")
        return written(with_sets.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_block_links, schema), name)

    many = large.groupBy("key").agg(F.ceil(F.sum("size") / NEAR_BLOCK).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / NEAR_PIVOTS).cast("int").alias("sparse"))
    rows = large.join(written(many, "near-blocks"), "key")
    own, pivot = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("sparse")) == 0)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = rows.select("key", "node", F.col("node").alias("component"), F.explode(F.when(pivot, every).otherwise(F.array(own))).alias("part"))
    links = run(first, "near-blocks-first")
    several = rows.where("blocks > 1")
    if not several.isEmpty():
        comp = components(found.unionByName(links), name="near-first-components")
        placed = written(several.join(comp, "node", "left").select("key", "node", "size", "blocks", F.coalesce("component", "node").alias("component")), "near-placed")
        each = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        main = each.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
        placed = placed.join(main, "key")
        rest = placed.where("component <> main")
        outer = rest.groupBy("key").agg(F.ceil(F.sum("size") / NEAR_BLOCK).cast("int").alias("outer"))
        # Parts are (block of outliers, block of all members); members stand in all parts of their block, outliers in all of theirs too.
        whole = placed.join(outer, "key").select("key", "node", "component", F.explode(F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda o: o * F.col("blocks") + own)).alias("part"))
        mine = F.pmod(F.xxhash64("node", F.lit(2)), F.col("outer")).cast("int")
        apart = rest.join(outer, "key").select("key", "node", "component", F.explode(F.transform(every, lambda t: mine * F.col("blocks") + t)).alias("part"))
        links = links.unionByName(run(whole.unionByName(apart), "near-blocks-second"))
    discard(sets)
    return links


def near_links(ids: DataFrame) -> DataFrame:
    """(a, b): near duplicates among rows (node, text) that connect what all near duplicates connect.

    Golay keys give the links within the code's reach. Bands of minhashes give the rest: at a Jaccard index of 0.8 a
    fingerprint's bits differ with a chance of 0.15, three or four in each 23-bit word, which is beyond what the code
    decodes. Whole sets of shingles decide.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(ids.mapInArrow(_near_rows, "key long, node long, size long"), "near-rows")
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = written(rows.join(counted, "key"), "near-shared")
    discard(rows)
    small = shared.where(F.col("members") <= NEAR_SMALL).select("key", "node", "size")
    small = small.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_small_pairs, "a long, b long")
    golay = _golay_pairs(ids)
    pairs = written(small.unionByName(golay).distinct(), "near-pairs")
    links = _near_pairs(pairs, ids)
    large = shared.where(F.col("members") > NEAR_SMALL).select("key", "node", "size")
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, ids, links))
    discard(shared, golay, pairs)
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: bool = False) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest id; columns as they were.

    Two texts are near duplicates if the sets of their five-word shingles have a Jaccard index of 0.8 or more; groups
    are what such links connect. Texts without words and rows without an id are in no group. Rows with one id are
    judged together. Ids may be of any type that sorts. An empty table stays empty. docs is read several times: what
    isn't a `table`, the same in every reading, is written first.
    """
    docs = docs if table else written(docs, "near-docs")
    node = private(docs, "near_node")
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        names, key = None, F.col(id_col).cast("long")
        ids = docs.select(key.alias("node"), F.col(text_col).alias("text"))
    else:  # numbers in the order of the ids
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        names = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().repartitionByRange(parts, "id").sortWithinPartitions("id")
        names = written(names.withColumn("node", F.monotonically_increasing_id()), "near-names")
        ids = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(names, "id").select("node", "text"), "near-ids")
    drop = components(near_links(ids), name="near-components").where("node <> component").select(F.col("node").alias(node))
    if names is not None:
        drop = drop.join(names.select(F.col("node").alias(node), "id"), node).select(F.col("id").alias(node))
    return docs.join(drop, docs[id_col] == drop[node], "left_anti")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """simhash_groups of all documents; nulls, ties, empty and repeated rows as there."""
    return simhash_groups(documents(spark, sf_dir))
