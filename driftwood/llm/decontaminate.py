"""Benchmark decontamination by winnowing.

Every run of T words of either side has one fingerprint: the least K-gram hash of its T - K + 1 K-grams.  Documents are
met with test items by a join on equal windows: a window of a document whose fingerprint the test set has is extended to
its T words and joined on the SHA-256 of these words, so a match rests on the words and not on a 64-bit hash.  Items of
fewer than T words are one window of their own length.

The test set stays a table of any size.  Only a bitmap of its fingerprints and window hashes is broadcast; its size is
fixed (FILTER_BITS), and a test set that fills it merely lets more windows into the join.  Documents are scanned once;
those without a candidate window, nearly all, are never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import textkit as tk
from driftwood.llm.common import fresh, materialize, table, tune

U64 = np.uint64
#: Words of a window, words of a fingerprint's k-gram.
SPAN, GRAM = 10, 5
#: The broadcast bitmap has 2**FILTER_BITS bits (8 MB).
FILTER_BITS = 26


def fingerprints(words: np.ndarray, span: int, gram: int) -> np.ndarray:
    """The least k-gram hash of every window of span words, ignoring document ends."""
    g = tk.grams(words, gram)
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, U64)
    least = g[:n].copy()
    for j in range(1, span - gram + 1):
        np.minimum(least, g[j : j + n], out=least)
    return least


def _digests(data, starts, ends, at, n):
    """SHA-256 of the n words from each of these positions, joined by spaces, which no word holds."""
    raw = data.tobytes()
    for p in at.tolist():
        yield hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(starts[p : p + n].tolist(), ends[p : p + n].tolist(), strict=True)])).digest()


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def _item_windows(span, gram, bits):
    """Arrow scan of (item, text): a row for each window, with its digest, its words and its slots in the bitmap."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in tk.slices(batch.column("text")):
                data = tk.LOWER[data]
                starts, ends, bounds = tk.words(data, offs, tk.ALNUM)
                h = tk.word_hashes(data, starts, ends)
                least = fingerprints(h, span, gram)
                for k, item in enumerate(batch.column("item").slice(lo, hi - lo).to_pylist()):
                    size = int(bounds[k + 1] - bounds[k])
                    if not size:
                        continue
                    n = min(span, size)
                    at = np.arange(bounds[k], bounds[k + 1] - n + 1)
                    whole = _slot(tk.grams_at(h, at, n), bits)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([item] * len(at), pa.string()),
                            pa.array(_digests(data, starts, ends, at, n), pa.binary()),
                            pa.array(np.full(len(at), n), pa.int32()),
                            pa.array(whole, pa.int64()),
                            pa.array(_slot(least[at], bits) if n == span else whole, pa.int64()),
                        ],
                        ["item", "digest", "n", "whole", "print"],
                    )

    return run


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, those of the windows' slots set; the driver gets at most one row for each 64 of them."""
    slot = F.col("slot")
    words = windows.select(F.explode(F.array("whole", "print")).alias("slot")).groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))
    found, out = words.toPandas(), np.zeros(max(1, 1 << bits >> 6), U64)
    out[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(U64)
    return out


def _scan(shared, n_words: str, cand: str, keep_text: bool):
    """Arrow scan that adds n_words and the distinct candidate windows of a document with their positions, null if there are none."""

    def run(batches):
        bitmap, bits, lengths, span, gram = shared.value

        def has(h):
            slot = _slot(h, bits)
            return (bitmap[slot >> 6] >> (slot & 63).astype(U64)) & U64(1) == 1

        def candidates(h, bounds, n):
            if n < span:
                g = tk.grams(h, n)
                return np.flatnonzero(has(g) & tk.inside(bounds, n, len(g)))
            least = fingerprints(h, span, gram)
            if not len(least):
                return np.zeros(0, np.int64)
            first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))  # windows beside each other mostly share theirs
            at = np.flatnonzero(np.repeat(has(least[first]), np.diff(np.append(first, len(least)))) & tk.inside(bounds, span, len(least)))
            return at[has(tk.grams_at(h, at, span))]

        kind = pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("at", pa.list_(pa.int32()))]))
        for batch in batches:
            for lo, hi, data, offs in tk.slices(batch.column("text")):
                data = tk.LOWER[data]
                starts, ends, bounds = tk.words(data, offs, tk.ALNUM)
                h = tk.word_hashes(data, starts, ends)
                found: list[dict] = [{} for _ in range(hi - lo)]
                for n in lengths:
                    at = candidates(h, bounds, n)
                    doc = np.searchsorted(bounds, at, "right") - 1
                    for k, p, digest in zip(doc.tolist(), (at - bounds[doc]).tolist(), _digests(data, starts, ends, at, n), strict=True):
                        found[k].setdefault((digest, n), []).append(p)
                rows = [[{"digest": d, "n": n, "at": at} for (d, n), at in own.items()] or None for own in found]
                part = batch.slice(lo, hi - lo)
                if not keep_text:
                    part = part.drop_columns("text")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bounds), pa.int64()), pa.array(rows, kind)], [*part.schema.names, n_words, cand])

    return run


def _marked(n_words: str, spans: str, hit: str):
    """Arrow scan that turns the confirmed windows of a document into a bitmap of its hit words."""

    def run(batches):
        for batch in batches:
            at = {name: j for j, name in enumerate(batch.schema.names)}
            hits = []
            for size, own in zip(batch.column(n_words).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                if not own:
                    hits.append(None)
                    continue
                change = np.zeros(size + 1, np.int64)
                for s in own:
                    first = np.array(s["at"], np.int64)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + s["n"], -1)
                hits.append(np.packbits(np.cumsum(change[:-1]) > 0).tobytes())
            columns = [c for j, c in enumerate(batch.columns) if j != at[spans]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.binary())], [*(n for n in batch.schema.names if n != spans), hit])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """docs, without text if keep_text is false, with n_words long, hit binary (bitmap of hit words, null if none) and items array<string>, any clashing columns replaced.

    A word is a run of digits, letters (A-Z lower-cased) and characters beyond ASCII.  Null texts have no words;
    empty tables, items without words and repeated rows or items are allowed; items of one id are one item.
    The columns that are kept pass through a written table.
    """
    spark = docs.sparkSession
    tune(spark)
    texts = benchmark.filter("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item"), "text")
    windows = materialize(texts.mapInArrow(_item_windows(span, gram, FILTER_BITS), "item string, digest binary, n int, whole long, print long"))
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # 1 to span
    shared = spark.sparkContext.broadcast((_bitmap(windows, FILTER_BITS), FILTER_BITS, lengths, span, gram))

    docs = docs.drop("n_words", "hit", "items")
    row, cand, spans, sets = fresh(docs, "row", "cand", "spans", "sets")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    docs = docs if keep_text else docs.drop("text")
    rows = docs.withColumn(row, F.monotonically_increasing_id()).withColumns({"n_words": F.lit(None).cast("long"), cand: F.lit(None).cast("array<struct<digest: binary, n: int, at: array<int>>>")})
    base = materialize(numbered.mapInArrow(_scan(shared, "n_words", cand, keep_text), rows.schema))

    # windows of the same items are one set, known by its size and two sums of hashes; aggregates are written before they are joined
    pairs = windows.select("item", "digest").distinct()
    name = F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64(F.lit(1), "item")))
    keys = materialize(pairs.groupBy("digest").agg(name.alias("set")))
    members = keys.groupBy("set").agg(F.min("digest").alias("digest")).join(pairs, "digest").select("set", "item")
    met = base.filter(F.col(cand).isNotNull()).select(row, F.explode(cand).alias("w")).select(row, "w.*").join(keys, "digest")
    found = materialize(met.groupBy(row).agg(F.collect_list(F.struct("n", "at")).alias(spans), F.array_sort(F.collect_set("set")).alias(sets)))  # of one document
    named = found.select(sets).distinct().select(sets, F.explode(sets).alias("set")).join(members, "set")
    named = materialize(named.groupBy(sets).agg(F.array_sort(F.collect_set("item")).alias("items")))

    hits = found.join(named, sets).select(row, spans, "items")
    order = [*docs.columns, "n_words", "items"]
    some = base.filter(F.col(cand).isNotNull()).join(hits, row, "left").select(*order, spans)
    marked = some.mapInArrow(_marked("n_words", spans, "hit"), some.drop(spans).withColumn("hit", F.lit(None).cast("binary")).schema)
    none = base.filter(F.col(cand).isNull()).select(*docs.columns, "n_words", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("binary").alias("hit"))
    return none.unionByName(marked).select(*docs.columns, "n_words", "hit", "items")


def op10_winnowing_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract: windows of ten words; counts, items and a verdict for every document."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)

    def digest(batches):
        for b in batches:
            hits = [0 if x is None else int.from_bytes(x, "big").bit_count() for x in b.column("hit").to_pylist()]
            items = [x or [] for x in b.column("items").to_pylist()]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([h > 0 for h in hits])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.select("doc_id", "n_words", "hit", "items").mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
