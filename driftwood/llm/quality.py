"""Quality classifier: random-indexing word vectors, pooled for each document, and a two-layer numpy network.

1. Every text of the corpus adds to the word vectors: each word's vector is the sum of the sparse random index vectors of
   the words beside it.  Words share WORDS hash buckets, so a task sends WORDS * DIM numbers, however large the corpus.
2. Labelled documents (a sample of at most SAMPLE, by hash) are pooled to the mean of their words' vectors; the network
   learns from four fifths of them, and its logits are divided by the temperature that suits the rest best.
3. One more pass over the texts scores every document.

Words are runs of letters (lower-cased), digits or punctuation; words in capitals, and words that repeat the one before,
each count as one word of their own, so that a vector stands for these habits as well.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import textkit as tk
from driftwood.llm.common import table, tune

WORDS, DIM, NONZERO = 1 << 13, 64, 4
#: Labelled documents that the network learns from, at most; all others are scored only.
SAMPLE = 20_000
CHUNK = 64
BYTES = 1 << 18

_KIND = np.zeros(256, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 punctuation
_KIND[33:] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
CAPITALS, REPEATED, DIGITS = 0, 1, 2

_rng = np.random.Generator(np.random.PCG64(11))
INDEX_AT = _rng.permuted(np.tile(np.arange(DIM, dtype=np.int64), (WORDS, 1)), axis=1)[:, :NONZERO].copy()
INDEX_SIGN = _rng.choice(np.array([-1.0, 1.0]), (WORDS, NONZERO))
INDEX = np.zeros((WORDS, DIM), np.float32)
np.put_along_axis(INDEX, INDEX_AT, INDEX_SIGN.astype(np.float32) / np.sqrt(NONZERO), 1)


def buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word buckets of some texts, and the bounds of each text in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offs[:-1][offs[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    shown = kind[starts] > 0
    starts, ends = starts[shown], ends[shown]
    bounds = np.searchsorted(starts, offs)
    h = tk.word_hashes(tk.LOWER[data], starts, ends)
    b = (h % np.uint64(WORDS - 3)).astype(np.int64) + 3
    b[kind[starts] == 2] = DIGITS
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (kind[starts[1:]] == 1)
    b[upper[ends] - upper[starts] >= 2] = CAPITALS
    b[same] = REPEATED
    return b, bounds


def _gather(batches):
    total = np.zeros(WORDS * DIM)
    for batch in batches:
        for _, _, data, offs in tk.slices(batch.column("text"), BYTES):
            b, bounds = buckets(data, offs)
            if len(b) < 2:
                continue
            ok = np.ones(len(b) - 1, bool)
            at = bounds[1:-1] - 1
            ok[at[(at >= 0) & (at < len(ok))]] = False
            left, right = b[:-1][ok], b[1:][ok]
            for word, beside in ((left, right), (right, left)):
                at = (word[:, None] * DIM + INDEX_AT[beside]).ravel()
                total += np.bincount(at, INDEX_SIGN[beside].ravel(), WORDS * DIM)
    parts = total.reshape(WORDS // CHUNK, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "sums"])


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK * DIM)
    for x in group.sums:
        total += np.frombuffer(x)
    return pd.DataFrame({"chunk": [group.chunk.iloc[0]], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """WORDS x DIM: each bucket's summed context scaled to length 1, plus its own index vector."""
    rows = docs.select("text").mapInArrow(_gather, "chunk long, sums binary").groupBy("chunk").applyInPandas(_added, "chunk long, sums binary").collect()  # WORDS / CHUNK rows
    out = np.zeros((WORDS // CHUNK, CHUNK * DIM))
    for row in rows:
        out[row.chunk] = np.frombuffer(row.sums)
    out = out.reshape(WORDS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32) + INDEX


def pooled(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and log of the word count of each text; zeros for a text without words."""
    b, bounds = buckets(data, offs)
    n = np.diff(bounds)
    out = np.zeros((len(n), DIM + 1), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        if len(b) > 1 << 18:  # a very long text: a vector for each bucket, weighted by its count, not one for each word
            for i in full:
                out[i, :DIM] = np.bincount(b[bounds[i] : bounds[i + 1]], minlength=WORDS) @ vectors / n[i]
        else:
            out[full, :DIM] = np.add.reduceat(vectors[b], bounds[full]) / n[full, None]
    out[:, DIM] = np.log1p(n)
    return out


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> Network:
    """Adam on the log loss with weight decay; then the temperature of least loss on a fifth that was set aside."""
    if not len(y):
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(y))
    aside, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    z, t = (x[own] - mean) / scale, y[own].astype(float)
    decay = 1e-4 + 1 / len(t)  # small samples need more of it
    params = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(t)), max(1, len(t) // 128)):
            h = np.tanh(z[part] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - t[part]) / len(part)
            back = np.outer(d, params[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z[part].T @ back + decay * params[0], back.sum(0), h.T @ d + decay * params[2], d.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if not len(aside):
        return net
    logits = net.logits(x[aside])
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, -np.where(y[aside] == 1, 1, -1) * logits / g).mean() for g in grid]
    return net._replace(temperature=float(grid[int(np.argmin(loss))]))


def _features(vectors):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in tk.slices(batch.column("text"), BYTES):
                x = pooled(data, offs, vectors.value)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("quality").slice(lo, hi - lo)], ["x", "quality"])

    return run


def _scores(model):
    def run(batches):
        vectors, net = model.value
        for batch in batches:
            for lo, hi, data, offs in tk.slices(batch.column("text"), BYTES):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(net(pooled(data, offs, vectors)).astype(float))], [*part.schema.names, "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs with score double: the probability that quality is 1.  Any column named score is replaced.

    Word vectors come from the texts of corpus (default: docs).  The network learns from the labels of documents that
    are not held out: all, or the sample of them with the least hashes.  Null labels and labels of no document are
    left out; a document with several labels counts with each.  Null and empty texts get the score of a text without
    words; without any label every score is 0.5.
    """
    spark = docs.sparkSession
    tune(spark)
    vectors = word_vectors(docs if corpus is None else corpus)
    shared = spark.sparkContext.broadcast(vectors)
    chosen = labels.filter("quality in (0, 1)").filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality").mapInArrow(_features(shared), "x binary, quality int")
    rows = sorted((bytes(r.x), r.quality) for r in rows.collect())  # sample rows of 260 bytes, times the rows of one doc_id
    x = np.frombuffer(b"".join(r[0] for r in rows), np.float32).reshape(len(rows), DIM + 1)
    net = train(x.astype(float), np.array([r[1] for r in rows]))
    docs = docs.drop("score")
    return docs.mapInArrow(_scores(spark.sparkContext.broadcast((vectors, net))), docs.select("*", F.lit(0.0).alias("score")).schema)


def op3_quality_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
