"""BPE encoding and decoding with a contiguous rank array.

A word is held as its parts and the ranks of adjacent parts, both contiguous lists. The smallest rank is looked for by
a scan, its boundary deleted, and the two neighbouring ranks refreshed, until no adjacent pair has a rank. Words longer
than SHORT bytes use a heap over the same ranks instead, which gives the same parts without the quadratic scan.

Text goes through the vocabulary file's own steps: special tokens' strings are cut out as they are; the rest is put
in NFC, white space dropped, lower-cased, split into letter runs, single digits, contractions and other runs, and its
UTF-8 bytes written as the file's byte characters. White space separates all of these, so a run of other characters
has the same ids wherever it stands, and runs seen before come from a bounded cache.
Words that aren't in it are merged many at a time: one row of a rank array for each word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents

VOCABULARY = "word_bpe_49k.json"
SHORT = 96
#: Words of up to this many bytes are merged together, a row of one array for each.
WIDE = 24
#: Texts are encoded together until they have this many characters.
GROUP = 1 << 19
#: Python's split() drops these, the vocabulary's pattern doesn't.
ODD = "\x1c\x1d\x1e\x1f"
#: Stands after every rank.
NONE = 1 << 60
#: The pair table's hash: a multiplier, and the bits that are used.
HASH, SHIFT, MASK = 0x9E3779B97F4A7, 28, (1 << 18) - 1
#: Entries of each half of the cache, some 150 bytes each; every Python worker has a cache of its own and keeps it.
CACHE = 100_000
#: Runs longer than this many characters aren't kept.
CACHED_LENGTH = 48


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def runs_of(text: str) -> list[str]:
    """The text in NFC without its white space."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.split() if not any(c in text for c in ODD) else regex.split(r"\s+", text)


class Encoder:
    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        #: By the ids of two parts: rank and merged id, as one integer that sorts by rank.
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        self.pair_table, self.rank_table = np.full(MASK + 1, -1), np.full(MASK + 1, NONE)
        places = (np.fromiter(self.ranks, np.int64) * HASH) >> SHIFT & MASK
        for (pair, rank), at in zip(self.ranks.items(), places.tolist(), strict=True):
            while self.pair_table[at] >= 0:
                at = (at + 1) & MASK
            self.pair_table[at], self.rank_table[at] = pair, rank
        chars = byte_characters()
        self.inner = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.end] for c in chars]
        self.inner_table, self.last_table = np.array(self.inner), np.array(self.last)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.strings = np.empty(1 + max([*self.vocab.values(), *self.special.values()]), dtype=object)
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.names = [str(i) for i in range(len(self.strings))]
        self.cache = cache
        #: Ids of runs and words seen of late; the older half goes when the younger is full.
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get = self.ranks.get
        ranks = [get(a << 20 | b, NONE) for a, b in pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = here = least & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | here, NONE)
            if i < len(ranks):
                ranks[i] = get(here << 20 | parts[i + 1], NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        get, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = r & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (r := get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def merge_many(self, words: list[bytes]) -> list[str]:
        """Decimal ids of words of two to WIDE bytes: the same rank arrays, one row for each word, scanned together."""
        out = [""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 4), (4, 8), (8, 12), (12, 16), (16, WIDE)):
            at = np.flatnonzero((size > low) & (size <= high))
            for k in range(0, len(at), 1 << 14):
                part = at[k : k + (1 << 14)]
                n = size[part]
                raw = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in part), np.uint8).reshape(len(part), high)
                ids = self.inner_table[raw]
                row = np.arange(len(part))
                ids[row, n - 1] = self.last_table[raw[row, n - 1]]
                col = np.arange(high - 1)
                ranks = np.where(col < (n - 1)[:, None], self._ranks(ids[:, :-1] << 20 | ids[:, 1:]), NONE)
                live = row
                p, r = ids, ranks
                while True:
                    i = r.argmin(1)
                    least = r[np.arange(len(i)), i]
                    go = least < NONE
                    if not go.all():
                        ids[live] = p
                        live, p, r, i, least = live[go], p[go], r[go], i[go], least[go]
                    if not len(live):
                        break
                    # Delete the boundary: what follows moves one place to the left.
                    n[live] -= 1
                    q = np.arange(len(live))
                    p[:, 1:-1] = np.where(col[:-1] >= i[:, None], p[:, 2:], p[:, 1:-1])
                    p[q, i] = least & 0xFFFFF
                    r[:, :-1] = np.where(col[:-1] >= i[:, None], r[:, 1:], r[:, :-1])
                    r[:, -1] = NONE
                    left, right = i > 0, i + 1 < n[live]
                    x, y = q[left], i[left]
                    r[x, y - 1] = self._ranks(p[x, y - 1] << 20 | p[x, y])
                    x, y = q[right], i[right]
                    r[x, y] = self._ranks(p[x, y] << 20 | p[x, y + 1])
                name = self.names
                for w, m, x in zip(part.tolist(), n.tolist(), ids.tolist(), strict=True):
                    out[w] = " ".join([name[y] for y in x[:m]])
        return out

    def _ranks(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of pairs by an open hash table; NONE where they have none."""
        at = (pairs * HASH) >> SHIFT & MASK
        found = self.pair_table[at]
        open_ = np.flatnonzero(((found != pairs) & (found >= 0)).ravel())
        at = at.ravel()
        flat, want = found.ravel(), pairs.ravel()
        while len(open_):
            at[open_] = (at[open_] + 1) & MASK
            flat[open_] = self.pair_table[at[open_]]
            open_ = open_[(flat[open_] != want[open_]) & (flat[open_] >= 0)]
        return np.where(flat >= 0, self.rank_table[at], NONE).reshape(pairs.shape)

    def _learn(self, runs: set[str]) -> None:
        """Puts the ids of runs that aren't known yet into the cache."""
        young, old = self.young, self.old
        pieces: dict[str, list[str]] = {}
        words: set[str] = set()
        for run in runs:
            ids = old.get(run)
            if ids is not None:
                young[run] = ids
                continue
            low = run.replace("Σ", "σ").lower()  # no final sigma
            pieces[run] = cut = [low] if low.isascii() and low.isalpha() else self.pieces.findall(low)
            for w in cut:
                if w not in young:
                    if w in old:
                        young[w] = old[w]
                    else:
                        words.add(w)
        some = list(words)
        raw = [w.encode() for w in some]
        short = [k for k, w in enumerate(raw) if 1 < len(w) <= WIDE]
        young.update(zip([some[k] for k in short], self.merge_many([raw[k] for k in short]), strict=True))
        for w, x in zip(some, raw, strict=True):
            if not 1 < len(x) <= WIDE:
                young[w] = " ".join(map(str, self.merge(x)))
        for run, cut in pieces.items():
            young[run] = young[cut[0]] if len(cut) == 1 else " ".join([young[w] for w in cut])

    def encode_texts(self, texts: list[str | None]) -> list[str]:
        """Decimal ids of each text, joined by one space."""
        if len(self.young) > self.cache:
            self.old, self.young = self.young, {}
        cut: list[list] = []
        for text in texts:
            if not text or "<|" not in text:
                cut.append(runs_of(text) if text else [])
            else:
                cut.append([])
                for piece in self.cut.split(text):
                    cut[-1] += [self.special[piece]] if piece in self.special else runs_of(piece)
        here: set = set()
        for runs in cut:
            here.update(runs)
        young = self.young
        for i in self.special.values():
            young[i] = str(i)
        self._learn({r for r in here if r not in young})
        known = {r: young[r] for r in here}
        for r in here:
            if isinstance(r, str) and len(r) > CACHED_LENGTH:
                young.pop(r, None)
        return [" ".join(filter(None, map(known.__getitem__, runs))) for runs in cut]

    def encode_text(self, text: str | None) -> str:
        return self.encode_texts([text])[0]

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encode_text(text).split()]

    def decode_text(self, ids: str) -> str:
        """The vocabulary's strings of decimal ids, joined by one space: the file names no other decoder."""
        return " ".join(self.strings[np.fromstring(ids, dtype=np.int32, sep=" ")].tolist()) if ids else ""

    def decode(self, ids: list[int]) -> str:
        return self.decode_text(" ".join(map(str, ids)))


def grouped(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about GROUP characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in (i for group in grouped(b.column(1).to_pylist()) for i in e.encode_texts(group)):
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(e.decode_text(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _round_trips(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = [i for group in grouped(b.column(1).to_pylist()) for i in e.encode_texts(group)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[int(x) for x in i.split()] for i in ids], pa.list_(pa.int32())), pa.array([e.decode_text(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def _two(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return df, f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded (text) for each row.

    Null and empty texts have no ids and decode to the empty text. Rows are independent: repeated rows repeat, other
    columns aren't read, an empty table gives an empty result.
    """
    df, key = _two(docs, id_col, text_col)
    return df.mapInArrow(_round_trips(path or vocabulary_path()), f"{key}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """encode_documents with lengths and digests in place of ids and texts, made where they are."""
    df, key = _two(docs, id_col, text_col)
    return df.mapInArrow(_digests(path or vocabulary_path()), f"{key}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """encode_digests of all documents; nulls, empty and repeated rows as in encode_documents."""
    return encode_digests(documents(spark, sf_dir))
