"""Secrets: patterns, and credentials whose parts stand together.

Assignments, access identifiers and long hex runs are reported wherever they stand. Weak candidates (bare tokens of
mixed characters, and endpoints) mean little alone: they are reported only when complementary parts co-occur. Parts are
linked by an interval join of the access identifiers, secrets and endpoints of one document: each part's interval is
looked up among the sorted starts and ends of the parts it needs, within SCOPE on either side.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents

#: Code points on either side within which parts belong together.
SCOPE = 200
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
#: Access identifiers that aren't base spans: other prefixes, and values named as one.
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|AGPA|ANPA|ANVA|ABIA|ACCA)[A-Z0-9]{12,}+")
NAMED = re.compile(r"""(?<![A-Za-z0-9])(?:access_?key(?:_?id)?|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}+""", re.IGNORECASE | re.ASCII)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9][A-Za-z0-9.-]{2,}+(?::[0-9]{1,5})?", re.ASCII)
MIN_BITS = 3.5

Span = tuple[str, int, int]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values())


def _weak(value: str) -> bool:
    kinds = any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value)
    return kinds == 3 and _entropy(value) >= MIN_BITS


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each base kind that don't overlap; failing ones are dropped, not retried."""
    low = text.lower()
    out: list[Span] = []
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run shorter than 24 can't match and a longer one matches whole, as the runs themselves would.
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


class _Near:
    """Intervals of one kind, sorted by start and by end; they may overlap."""

    def __init__(self, parts: list[tuple[int, int]]):
        self.starts, self.ends = sorted(s for s, _ in parts), sorted(e for _, e in parts)
        self.reach = list(accumulate((e for _, e in sorted(parts)), max))

    def beside(self, start: int, end: int, scope: int) -> bool:
        """Does one end within `scope` before start, or start within `scope` after end?"""
        i, j = bisect_right(self.ends, start - scope), bisect_left(self.starts, end)
        return i < len(self.ends) and self.ends[i] <= start or j < len(self.starts) and self.starts[j] < end + scope

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak secrets beside an access identifier of any kind, then identifiers and endpoints beside a secret of any kind."""
    access = [(s, e) for k, s, e in base if k == "access"]
    low = text.lower()
    found = [(m.start(), m.end()) for m in NAMED.finditer(text)] if "client" in low or "access" in low else []
    found += [(m.start(), m.end()) for m in PREFIXED.finditer(text)]
    own, names = _Near(access), []
    for s, e in sorted(set(found)):  # the first of those that overlap
        if not own.overlaps(s, e) and (not names or names[-1][1] <= s):
            names.append((s, e))
    strong = [(s, e) for k, s, e in base if k in ("assign", "hex")]
    if not access and not names and not strong:
        return []
    ids, taken = _Near(access + names), _Near([(s, e) for _, s, e in base] + names)
    weak = [(m.start(), m.end()) for m in WEAK.finditer(text)] if ids.starts else []
    weak = [(s, e) for s, e in weak if ids.beside(s, e, scope) and not taken.overlaps(s, e) and _weak(text[s:e])]
    secrets = _Near(strong + weak)
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if "http" in text else []
    return [("weak", s, e) for s, e in weak] + [("identifier", s, e) for s, e in names if secrets.beside(s, e, scope)] + [("endpoint", s, e) for s, e in ends if secrets.beside(s, e, scope)]


def _order(spans: list[Span]) -> list[Span]:
    kinds = (*BASE, "weak", "identifier", "endpoint")
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for t in b.column(1):
            text = t.as_py() or ""
            base = base_spans(text)
            for c, k in zip(cols, BASE, strict=False):
                c.append(sum(s[0] == k for s in base))
            cols[3].append(hashlib.sha256(_join(base).encode()).hexdigest())
            cols[4].append(_join(_order(base + linked_spans(text, base))))
        arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.string()) for c in cols[3:]]
        yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for b in batches:
        rows = []
        for t in b.column(1):
            text = t.as_py() or ""
            base = base_spans(text)
            rows.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in _order(base + linked_spans(text, base))])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])


def _two(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return df, f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end, value) for each row, by start.

    Null and empty texts have no spans. Repeated rows repeat, other columns aren't read, an empty table gives an empty
    result. Positions are code points, end exclusive.
    """
    df, key = _two(docs, id_col, text_col)
    return df.mapInArrow(_found, f"{key}, spans array<struct<kind:string,start:int,end:int,value:string>>")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_secrets with counts of the base kinds, the digest of the base spans and all spans as text, made where they are."""
    df, key = _two(docs, id_col, text_col)
    return df.mapInArrow(_digests, f"{key}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """secret_digests of all documents; nulls, empty and repeated rows as there."""
    return secret_digests(documents(spark, sf_dir))
