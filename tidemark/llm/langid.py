"""Language identification by nearest centroid.

A text's hashed byte n-grams are counted, weighted by TF-IDF and normalised. Each language has several centroids, from
spherical k-means over a bounded sample of its labelled documents; the nearest centroid by cosine names the language.
A text too far from every centroid is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents

#: Places that the n-grams are hashed to.
DIM = 4096
#: Labelled documents of each language that the fit looks at, at most, in the order of a hash.
SAMPLE = 400
CLUSTERS, ROUNDS = 4, 8
#: A text is rejected if its cosine with its nearest centroid is below REJECT times the QUANTILE of the cosines that
#: pieces as long as itself of the sample's documents have; LENGTHS are the pieces' numbers of n-grams.
REJECT, QUANTILE = 0.6, 0.01
LENGTHS = (16, 32, 64, 128, 256, 512, 1024, 2048, 4096)
UNKNOWN = "und"
CHUNK = 1 << 20

_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters is one blank.
_MAP = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed counts of byte bigrams and trigrams of the lower-cased text, blanks within words' ends included."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_MAP) + b" "
    out = np.zeros(DIM, np.float32)
    for k in range(0, len(raw), CHUNK):
        a = np.frombuffer(raw[k : k + CHUNK + 2], np.uint8).astype(np.uint32)
        a = a[: len(a)]
        two = a[:-1] << np.uint32(8) | a[1:]
        three = two[:-1] << np.uint32(8) | a[2:]
        # A chunk's last two bytes begin the next chunk: grams that start there are counted there.
        last = k + CHUNK >= len(raw)
        two = two if last else two[:CHUNK]
        three = three if last else three[:CHUNK]
        two = two[two != 0x2020]
        three = three[(three & np.uint32(0xFFFF)) != 0x2020]
        for g in (two + np.uint32(1 << 24), three):
            out += np.bincount((g * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM).astype(np.float32)
    return out


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    #: Language of each centroid.
    names: list[str]
    #: Lowest cosine that isn't rejected, for each of LENGTHS.
    floors: np.ndarray

    def floor(self, grams: np.ndarray) -> np.ndarray:
        """For texts of so many n-grams: straight between the LENGTHS' logarithms; those shorter than the first as the first."""
        return np.interp(np.log(np.maximum(grams, 1)), np.log(LENGTHS), self.floors)

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        v = np.log1p(tf) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text; unknown, 0 and rejected if it is null or has no letter."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        can = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.names else []
        for k in range(0, len(can), 128):
            part = can[k : k + 128]
            tf = np.stack([counts(texts[i]) for i in part])
            near = self.vectors(tf) @ self.centroids.T
            best = near.argmax(1)
            for i, b, s, low in zip(part, best, near[np.arange(len(part)), best], self.floor(tf.sum(1)), strict=True):
                s = float(min(1.0, max(0.0, s)))
                out[i] = (self.names[b], s, s <= 0 or s < low)
        return out


def fit(rows: list[tuple[str, np.ndarray]], clusters: int = CLUSTERS, rounds: int = ROUNDS) -> Model:
    """From (language, counts), in an order that doesn't depend on chance."""
    if not rows:
        return Model(np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), [], np.zeros(len(LENGTHS)))
    tf = np.stack([c for _, c in rows])
    idf = (np.log((1 + len(rows)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    model = Model(idf, np.zeros((0, DIM), np.float32), [], np.zeros(len(LENGTHS)))
    v, langs = model.vectors(tf), np.array([n for n, _ in rows])
    centroids, names = [], []
    for name in sorted(set(langs)):
        x = v[langs == name]
        c = [x[0]]
        while len(c) < min(clusters, len(x)):  # farthest first
            c.append(x[(x @ np.stack(c).T).max(1).argmin()])
        c = np.stack(c)
        for _ in range(rounds):
            at = (x @ c.T).argmax(1)
            c = np.stack([x[at == k].sum(0) if (at == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        centroids.append(c)
        names += [name] * len(c)
    model.centroids, model.names = np.concatenate(centroids).astype(np.float32), names
    # A piece of a text: so many n-grams drawn from its counts. Lengths that no document of the sample reaches take the next shorter one's floor.
    draw = np.random.default_rng(1)
    total = tf.sum(1).astype(np.int64)
    for k, n in enumerate(LENGTHS):
        rows = np.flatnonzero(total >= n)
        near = [float((model.vectors(piece[None]) @ model.centroids.T).max()) for piece in (_piece(tf[i], n, draw) for i in rows)]
        model.floors[k] = REJECT * float(np.quantile(near, QUANTILE)) if near else model.floors[k - 1] if k else 0.0
    return model


def _piece(tf: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    at = np.flatnonzero(tf)
    out = np.zeros(DIM, np.float32)
    out[at] = draw.multivariate_hypergeometric(tf[at].astype(np.int64), n, method="marginals")
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 128):
            part = b.slice(k, 128)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([counts(t.as_py()).tobytes() for t in part.column(2)], pa.binary())], names=["lang", "o", "tf"])


def train(labelled: DataFrame, order: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits to at most `sample` documents of each language, the first by `order` (a long).

    The driver holds up to `sample` sparse count vectors a language, as many as languages have labels. Rows without text or language aren't used. Whole texts are counted where they are; only counts reach the driver.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), order.alias("o"), F.col(text_col).alias("text"))
    # By a hash, about twice as many of each language as are wanted; the driver keeps the first of these. What is
    # broadcast has a row for each language; the driver gets sample * 16 kB of counts for each.
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2 * sample + 8) / F.count(F.lit(1))).alias("share"))
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod("o", F.lit(1 << 30)) <= F.col("share") * (1 << 30)).select("lang", "o", "text")
    got: dict[str, list[tuple[int, bytes]]] = {}
    for r in picked.mapInArrow(_counted, "lang string, o long, tf binary").toLocalIterator():
        got.setdefault(r["lang"], []).append((r["o"] % (1 << 30), bytes(r["tf"])))
    return fit([(n, np.frombuffer(tf, np.float32)) for n in sorted(got) for _, tf in sorted(got[n])[:sample]])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row.

    A null text, and one without letters, is `und`, 0 and rejected. Ties go to the language first by name. Repeated rows
    repeat, other columns aren't read, an empty table gives an empty result; a model without languages rejects all.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # CLUSTERS * DIM floats for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = zip(*shared.value.predict(b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def fold(id_col: str = "doc_id") -> Column:
    """Held out: crc32 of the id as text, by 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train_outside_fold(docs: DataFrame) -> Model:
    return train(docs.where(~fold()), F.xxhash64(F.col("doc_id")))


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text the model rejects; columns as they were.

    Null texts and texts without letters go; repeated rows share their fate; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array([not r for *_, r in shared.value.predict(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """identify() on all documents by a model of those outside the held-out fold; nulls, empty and repeated rows as there."""
    docs = documents(spark, sf_dir)
    out = identify(docs, train_outside_fold(docs))
    return out.select("doc_id", fold().alias("held_out"), "lang_pred", "score", "rejected")
