"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

Ids come from the tokenizers library. White space separates what it encodes, so each word is encoded once by the library
and looked up after that.

Ids are coded in blocks of at most BLOCK ids. Every block starts from an empty model and carries the CRC-32 of its words
and ids, so any block is checked or lost alone. In a block the id that followed the same two ids (order 2) or the same id
(order 1) last is predicted; the orders' hit rates are mixed in the logistic domain, with rates and weights learned every
EVERY ids, and an arithmetic coder with carries codes "as predicted" or else the id by order 0: its share of the record's
ids that weren't predicted, from a table in the head. All of it is integer arithmetic, so any machine reads what another
one wrote. The blocks of a record run in lockstep, one array lane each: encoder and decoder cost a fixed number of array
operations for each position in a block, however many blocks there are.

A record (one row of the written table) holds whole documents: shard and seq (its place), doc_ids and lengths, and an
image: magic, the head's CRC-32, the head (numbers of blocks, ids, different ids and bytes of the table, words and CRC-32
of each block, the table, deflated), then the blocks' 32-bit words. Without its head a record can't be read.
"""

from __future__ import annotations

import gc
import json
import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import CACHED_LENGTH, ODD, grouped, runs_of, vocabulary_path
from tidemark.llm.common import documents, written

END_ID = 2
#: Ids of a block: at most; and at least, where a record has fewer than LANES blocks otherwise.
BLOCK, SHORT_BLOCK, LANES = 2048, 512, 3072
#: Ids in a record, about: what one task holds at a time.
RECORD = BLOCK * LANES
#: Runs and words that each half of the cache of ids holds, and how many the library is given in one text.
CACHE, JOINED = 800_000, 64
#: Characters whose case and kind all versions of Unicode agree on (without U+0130, which lower case makes two of), and the
#: vocabulary's pattern over these and ASCII.
_PLAIN = [chr(c) for c in range(0x180) if c not in range(0x7F, 0xA1) and c != 0x130]
PLAIN = re.compile("[" + "".join(map(re.escape, _PLAIN)) + "]+")
_LETTERS, _NUMBERS = ("".join(c for c in _PLAIN if unicodedata.category(c)[0] == kind) for kind in "LN")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
MAGIC = b"TMTM"
#: Contexts of a lane's tables, and the bits of a 16-bit hash that are dropped for them.
_TABLE, _HASH = 512, 7
#: Bits of a prediction's chance. Ids after which rates and weights are learned anew.
_PREC, EVERY = 12, 32
_U = np.uint64
_WORD = _U(1 << 32)
STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)])
SQUASH = np.array([max(32, min(4032, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)])


class LibraryIds:
    """Ids of texts from the tokenizers library, four bytes each; what was seen before comes from a bounded cache.

    Runs of PLAIN characters are cut into the words that the vocabulary's pattern finds, and each word that hasn't been seen is
    encoded by the library, many at once: the last id of a word, and no other, is one of a word's end. Other runs go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocabulary, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]), bool)
        self.last[[i for s, i in vocabulary.items() if s.endswith(end)]] = True
        #: Of runs, and of the words in them.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of any runs."""
        out = []
        for k in range(0, len(runs), JOINED):
            part = runs[k : k + JOINED]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            # Each id belongs to the run that it starts in.
            starts = np.r_[0, np.cumsum([len(run) + 1 for run in part])]
            cuts = (4 * np.searchsorted(np.fromiter((at for at, _ in e.offsets), np.int64, len(e.ids)), starts)).tolist()
            ids = np.array(e.ids, "<u4").tobytes()
            out += [ids[x:y] for x, y in pairwise(cuts)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of PLAIN characters."""
        parts = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            ids = ids.tobytes()
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                raise ValueError("the library cuts words elsewhere")
            out += [ids[x:y] for x, y in pairwise([0, *cuts])]
        return out

    def _learn(self, runs: set[str]) -> None:
        """Puts the ids of runs that aren't known yet into the cache."""
        young, old = self.young, self.old
        cut: dict[str, list[str]] = {}
        words: set[str] = set()
        odd = []
        for run in runs:
            ids = old.get(run)
            if ids is not None:
                young[run] = ids
                continue
            if not (run.isascii() or PLAIN.fullmatch(run)):
                odd.append(run)
                continue
            low = run.lower()
            if low.isalpha():
                if low == run:
                    words.add(run)
                    continue
                found = [low]
            elif "<" in run and any(s in run for s in self.special):
                odd.append(run)
                continue
            else:
                found = WORDS.findall(low)
            cut[run] = found
            for word in found:
                if word not in young:
                    ids = old.get(word)
                    if ids is None:
                        words.add(word)
                    else:
                        young[word] = ids
        fresh = list(words)
        young.update(zip(fresh, self._words(fresh), strict=True))
        young.update(zip(odd, self._runs(odd), strict=True))
        for run, found in cut.items():
            young[run] = young[found[0]] if len(found) == 1 else b"".join([young[w] for w in found])
        self.long = [x for x in (*fresh, *cut, *odd) if len(x) > CACHED_LENGTH]

    def _cut(self, text: str) -> list[str]:
        """The runs of a text; in lower case already where that can't change what special tokens it has."""
        try:
            text.encode("latin-1")  # such text is in NFC
        except UnicodeEncodeError:
            return runs_of(text)
        return runs_of(text) if "<|" in text or any(c in text for c in ODD) else text.lower().split()

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        cut = [self._cut(t) if t else [] for t in texts]
        collects = gc.isenabled()
        gc.disable()  # millions of strings, none in a cycle
        try:
            return self._ids(cut)
        finally:
            if collects:
                gc.enable()

    def _ids(self, cut: list[list[str]]) -> list[bytes]:
        get, unseen, gaps = self.young.get, set(), []
        out = [list(map(get, runs)) for runs in cut]
        for runs, ids in zip(cut, out, strict=True):
            if None in ids:
                gaps.append((ids, places := [k for k, x in enumerate(ids) if x is None], missed := [runs[k] for k in places]))
                unseen.update(missed)
        self._learn(unseen)
        for ids, places, missed in gaps:
            for k, run in zip(places, missed, strict=True):
                ids[k] = get(run)
        for x in self.long:
            self.young.pop(x, None)
        return [b"".join(ids) for ids in out]


_IDS: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    """One for each Python process and file."""
    if path not in _IDS:
        _IDS[path] = LibraryIds(path)
    return _IDS[path]


class _Model:
    """Predictions of the next id of every lane by order 2 or 1, and their chances, mixed from both orders' hit rates.

    A table's entries are an id and how often it came in a row, up to three (two bits). Rates and weights are learned every EVERY ids.
    """

    def __init__(self, lanes: int, kind: type):
        lane = np.arange(lanes)
        #: Order 2, then order 1, of each lane.
        self.base, self.cell, self.lanes = np.arange(2 * lanes) * _TABLE, lane * 16, lanes
        self.table = np.zeros(2 * lanes * _TABLE, kind)
        self.key, self.before = np.zeros(2 * lanes, np.uint16), np.zeros(lanes, np.uint16)
        self.cells, self.hits, self.t = np.zeros((EVERY, lanes), np.int64), np.zeros((EVERY, lanes), bool), 0
        #: By lane, and by what order 2 and order 1 have: the rates of order 2, order 1, either.
        self.rates = [np.full((lanes, *x), 16384) for x in ((4, 1), (1, 4), (1, 1))]
        self.weights = [np.full((lanes, 1, 1), 26000) for _ in range(3)]
        self._mix()

    def _mix(self) -> None:
        self.stretched = [STRETCH[r >> 4] for r in self.rates]
        dot = sum(w * x for w, x in zip(self.weights, self.stretched, strict=True)) >> 16
        self.p = SQUASH[np.minimum(np.maximum(dot, -2047), 2047) + 2047]
        self.chances = self.p.ravel().astype(np.uint64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(predicted id, its share of 2^_PREC) for each lane."""
        self.at = (self.key >> _HASH).astype(np.int64)
        self.at += self.base
        self.entry = e = self.table.take(self.at)
        self.count = c = e & 3
        cell = self.cells[self.t]
        two = c[: self.lanes]
        np.add(two << 2 | c[self.lanes :], self.cell, out=cell)
        return np.where(two > 0, e[: self.lanes], e[self.lanes :]) >> 2, self.chances.take(cell)

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        e, c, wide = self.entry, self.count, np.concatenate((ids, ids)) << 2
        self.table[self.at] = np.where((e ^ wide) < 4, e + (c < 3), np.where(c < 2, wide | 1, e - 1))
        now = ids.astype(np.uint16) * 40503
        np.add(self.before * 30011, now, out=self.key[: self.lanes])
        self.key[self.lanes :] = self.before = now
        self.hits[self.t] = hit
        self.t += 1
        if self.t == EVERY:
            self.t = 0
            n, h = (np.bincount(x, minlength=self.p.size).reshape(self.p.shape) for x in (self.cells.ravel(), self.cells[self.hits]))
            err = (h << 12) - n * self.p
            for k, (r, x) in enumerate(zip(self.rates, self.stretched, strict=True)):
                over = tuple(d for d in (1, 2) if r.shape[d] == 1)
                self.weights[k] = np.minimum(np.maximum(self.weights[k] + ((x * err).sum((1, 2), keepdims=True) >> 10), -(1 << 20)), 1 << 20)
                r += (h.sum(over, keepdims=True) * 65535 - n.sum(over, keepdims=True) * r) >> 5
            self._mix()


def _lengths(n: int) -> tuple[int, int]:
    """(blocks, ids of each but the last) of a record of n ids."""
    lanes = max(-(-n // BLOCK), min(LANES, -(-n // SHORT_BLOCK)))
    each = -(-n // max(lanes, 1))
    return (-(-n // each) if n else 0), each


def _kind(symbols: int) -> tuple[type, int]:
    """(type of a context table's entries, bits of order 0's shares) for so many different ids."""
    return (np.uint16, 16) if symbols <= 1 << 14 else (np.uint32, 18)


def compress(ids: np.ndarray) -> bytes:
    """The image of ids (0 to 131071)."""
    n = len(ids)
    lanes, each = _lengths(n)
    there = np.bincount(ids) > 0
    names = np.flatnonzero(there)
    kind, bits = _kind(len(names))
    grid = np.zeros(lanes * each, kind)
    grid[:n] = (np.cumsum(there) - 1).astype(kind)[ids]
    grid = grid.reshape(lanes, each).T.copy()
    m, hits, shares = _Model(lanes, kind), np.empty(grid.shape, bool), np.empty(grid.shape, np.uint16)
    for t in range(each):
        guess, shares[t] = m.predict()
        np.equal(guess, grid[t], out=hits[t])
        m.update(grid[t], hits[t])
    # Order 0: each id's share of those that weren't predicted.
    missed = np.bincount(grid[~hits], minlength=len(names))
    size = (missed > 0) + missed * ((1 << bits) - np.count_nonzero(missed)) // max(1, int(missed.sum()))
    if n:
        size[size.argmax()] += (1 << bits) - size.sum()
    sizes, starts = size.astype(np.uint64), (np.cumsum(size) - size).astype(np.uint64)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0))
    out, pos = np.zeros((lanes, each + 4), np.uint32), np.zeros(lanes, np.int64)
    for t in range(each):
        # As predicted, or else the id by its share of the rest.
        hit, x = hits[t], grid[t]
        share = (span >> _U(_PREC)) * shares[t]
        unit = (span - share) >> _U(bits)
        start = np.where(hit, _U(0), share + unit * starts.take(x))
        span = np.where(hit, share, unit * sizes.take(x))
        low += start
        at = np.flatnonzero(low < start)
        if len(at):  # a carry goes into the words already given
            j = pos[at] - 1
            while len(at):
                out[at, j] += np.uint32(1)
                more = out[at, j] == 0
                at, j = at[more], j[more] - 1
        at = np.flatnonzero(span < _WORD)
        if len(at):
            now, place = low[at], pos[at]
            out[at, place] = now >> _U(32)
            pos[at] = place + 1
            low[at] = now << _U(32)
            span[at] <<= _U(32)
    for _ in range(2):
        out[np.arange(lanes), pos] = low >> _U(32)
        pos += 1
        low <<= _U(32)
    little = np.ascontiguousarray(ids, dtype="<u4")
    words = [out[k, : pos[k]].astype("<u4").tobytes() for k in range(lanes)]
    crc = [zlib.crc32(little[k * each : (k + 1) * each], zlib.crc32(words[k])) for k in range(lanes)]
    table = zlib.compress(np.r_[np.diff(names, prepend=0), size].astype("<u4").tobytes())
    head = np.r_[lanes, n, len(names), len(table), pos, crc].astype("<u4").tobytes() + table
    return MAGIC + np.array([zlib.crc32(head)], "<u4").tobytes() + head + b"".join(words)


def decompress(image: bytes) -> np.ndarray:
    """The ids of an image; ValueError if its head or a block isn't what was written."""
    if image[:4] != MAGIC or len(image) < 24:
        raise ValueError("not a token-id record")
    lanes, n, symbols, tabled = (int(x) for x in np.frombuffer(image, "<u4", 4, 8))
    body = 24 + 8 * lanes + tabled
    if zlib.crc32(memoryview(image)[8:body]) != int.from_bytes(image[4:8], "little"):
        raise ValueError("the head is damaged")
    if not lanes:
        return np.zeros(0, np.uint32)
    each = -(-n // lanes)
    length, crc = np.frombuffer(image, "<u4", lanes, 24).astype(np.int64), np.frombuffer(image, "<u4", lanes, 24 + 4 * lanes)
    table = np.frombuffer(zlib.decompress(image[24 + 8 * lanes : body]), "<u4").astype(np.int64)
    names, size = np.cumsum(table[:symbols]).astype(np.uint32), table[symbols:]
    kind, bits = _kind(symbols)
    sizes, starts, found = size.astype(np.uint64), (np.cumsum(size) - size).astype(np.uint64), np.repeat(np.arange(symbols, dtype=kind), size)
    data = np.frombuffer(image[body:], "<u4", int(length.sum())).astype(np.uint64)
    data = np.r_[data, np.zeros(2, np.uint64)]
    ends = body + 4 * np.cumsum(length)
    pos = np.cumsum(length) - length
    code = data[pos] << _U(32) | data[pos + 1]
    pos += 2
    last, limit = _U((1 << bits) - 1), len(data) - 1
    span = np.full(lanes, ~_U(0))
    m, grid = _Model(lanes, kind), np.empty((each, lanes), kind)
    for t in range(each):
        guess, share = m.predict()
        share *= span >> _U(_PREC)
        hit = code < share
        unit = (span - share) >> _U(bits)
        rest = code - share
        x = found.take(np.minimum(rest // unit, last).view(np.int64))
        code = np.where(hit, code, rest - unit * starts.take(x))
        span = np.where(hit, share, unit * sizes.take(x))
        at = np.flatnonzero(span < _WORD)
        if len(at):
            place = pos[at]
            code[at] = code[at] << _U(32) | data[np.minimum(place, limit)]  # a damaged block may lead anywhere
            pos[at] = place + 1
            span[at] <<= _U(32)
        x = np.where(hit, guess, x)
        m.update(x, hit)
        grid[t] = x
    ids = names[np.ascontiguousarray(grid.T).reshape(-1)[:n]].astype("<u4")
    for k in range(lanes):
        words = memoryview(image)[ends[k] - 4 * length[k] : ends[k]]
        if zlib.crc32(ids[k * each : (k + 1) * each], zlib.crc32(words)) != crc[k]:
            raise ValueError(f"block {k} is damaged")
    return ids


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard, seq = library_ids(path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        docs: list = []
        held: list[bytes] = []
        size = 0

        def give(kind: pa.DataType) -> pa.RecordBatch:
            image = compress(np.frombuffer(b"".join(held), "<u4"))
            arrays = [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([docs], pa.list_(kind)), pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int64())), pa.array([image], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "seq", "doc_ids", "lengths", "image"])

        for b in batches:
            kind, at = b.column(0).type, 0
            ids_of = b.column(0).to_pylist()
            for group in grouped(b.column(1).to_pylist()):
                for ids in e.encode_texts(group):
                    held.append(ids + end)
                    docs.append(ids_of[at])
                    at += 1
                    size += len(ids) // 4 + 1
                    if size >= RECORD:
                        yield give(kind)
                        seq, docs, held, size = seq + 1, [], [], 0
        if held:
            yield give(kind)

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            ids = decompress(b.column(4)[k].as_py())
            length = np.array(b.column(3)[k].as_py(), np.int64)
            end = np.cumsum(length)
            crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(end.tolist(), length.tolist(), strict=True)]
            same = lambda v, n=len(length): pa.array(np.full(n, v.as_py(), np.int32))
            yield pa.RecordBatch.from_arrays([same(b.column(0)[k]), same(b.column(1)[k]), b.column(2)[k].values, pa.array(end - length), pa.array(length), pa.array(crc, pa.int64())], names=["shard", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the ids of docs, END_ID after each, in ascending doc_id order, and gives the written records.

    Null and empty texts are END_ID alone. Null doc_ids come first; rows with equal doc_ids stand in the order of their
    texts. Other columns aren't read. An empty table writes no record.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(_write(path or vocabulary_path()), f"shard int, seq int, doc_ids array<{key}>, lengths array<long>, image binary"), "token-ids")


def read_tokens(records: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32 of each document, from the records' images."""
    sizes = records.select("shard", "seq", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    inside = sizes.withColumn("before", F.coalesce(F.sum("ids").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One row for each shard: as many as there are tasks.
    shards = sizes.groupBy("shard").agg(F.sum("ids").alias("all")).withColumn("ahead", F.coalesce(F.sum("all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offset = inside.join(shards, "shard").select("shard", "seq", (F.col("ahead") + F.col("before")).alias("offset"))
    key = records.schema["doc_ids"].dataType.elementType.simpleString()
    rows = records.mapInArrow(_read, f"shard int, seq int, doc_id {key}, within long, n_tokens long, ids_crc32 long")
    return rows.join(offset, ["shard", "seq"]).select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_ids(spark, sf_dir: str) -> DataFrame:
    """write_tokens and read_tokens over all documents; nulls, ties, empty and repeated rows as there."""
    return read_tokens(write_tokens(documents(spark, sf_dir)))
