"""Near-duplicate documents: universal hash minima, banding, signature check, exact confirmation, star components.

Plan
1. One pass over the texts gives each document its set size, a 128-bit set fingerprint, its minima and band keys.
2. Documents of equal sets form a class, which is numbered; only one row of a class goes on.  A doc_id says nothing
   about a class: repeated ids with different texts are in different ones.
3. The sets of all classes that share a band bucket are fetched once, by a shuffle of the texts to their ids.
4. In each band bucket every class is compared with the bucket's least one and its greatest one (never all pairs), which joins
   dense groups.  Candidates pass a signature estimate, then are confirmed on their full sets.  Components follow from the links.
5. In buckets that still hold several components, the members of different ones are compared: in a small bucket as
   pairs whose sizes and low bits of the minima allow the similarity; the members of large buckets are
   clustered, and the sets of a cluster of sizes that allow the similarity meet in blocks, which send their links and no pairs.
6. The least doc_id of a component names it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import textkit as tk
from driftwood.llm.common import materialize, table, tune
from driftwood.llm.components import components

U64 = np.uint64
#: Representatives of a small bucket, at most; of a block of a cluster.
BUCKET, BLOCK = 64, 256
#: Heads of a bucket after its least class that all its classes are compared with: none, or its greatest class.
ROUNDS = 1
#: Bytes of text that one vectorised step works on.
STEP = 1 << 18


class Minima:
    """bands * rows universal hashes h -> (a h + b) mod 2^64 div 2^32, and their bands."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * U64(2) + U64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def signatures(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """uint32 minima, one row for each document; documents without shingles must have been left out."""
        out = np.empty((len(bounds) - 1, len(self.a)), np.uint32)
        for k in range(len(self.a)):
            out[:, k] = np.minimum.reduceat((hashes * self.a[k] + self.b[k]) >> U64(32), bounds[:-1])
        return out

    def keys(self, sig: np.ndarray) -> np.ndarray:
        out = np.empty((len(sig), self.bands), U64)
        for band in range(self.bands):
            acc = np.full(len(sig), band + 1, U64)
            for r in range(self.rows):
                acc = tk.mix(acc * U64(0x9FB21C651E98DF25) + sig[:, band * self.rows + r])
            out[:, band] = acc
        return out


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set of hashes; 0 for an empty one."""
    out = np.zeros((2, len(bounds) - 1), U64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[0, full] = np.add.reduceat(tk.mix(h), bounds[full])
        out[1, full] = np.add.reduceat(tk.mix(h ^ U64(0xA5A5A5A55A5A5A5A)), bounds[full])
    return out[0], out[1]


def _profile(size: int, minima: Minima):
    width = minima.bands * minima.rows * 4

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for lo, hi, data, offs in tk.slices(text, STEP):
                h, bounds = tk.shingle_sets(data, offs, size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                f1, f2 = fingerprints(h, bounds)
                bits = np.zeros((2, hi - lo), np.int64)
                sig = [None] * (hi - lo)
                keys: list = [None] * (hi - lo)
                if len(full):
                    at = np.concatenate((bounds[full], bounds[-1:]))
                    minimum = minima.signatures(h, at)
                    low = np.packbits((minimum[:, :128] & 1).astype(bool), axis=1).view(np.int64)
                    bits[0, full], bits[1, full] = low[:, 0], low[:, -1]
                    raw, band = minimum.tobytes(), minima.keys(minimum).view(np.int64)
                    for j, i in enumerate(full):
                        sig[i] = raw[j * width : (j + 1) * width]
                        keys[i] = band[j]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(bits[0]), pa.array(bits[1]), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "f1", "f2", "low1", "low2", "bands", "sig"],
                )

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in tk.slices(batch.column("text"), STEP):
                h, bounds = tk.shingle_sets(data, offs, size)
                raw = h.tobytes()
                own = [raw[bounds[i] * 8 : bounds[i + 1] * 8] for i in range(hi - lo)]
                f1, f2 = fingerprints(h, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(np.diff(bounds), pa.int64()), pa.array(own, pa.binary())], ["f1", "f2", "n_shingles", "hashes"])

    return run


def _resembling(least: float):
    """Keep pairs whose minima agree in a share of at least least."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            ok = (x == y).mean(1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _confirmed(num: int, den: int):
    """Keep pairs with den * |intersection| >= num * |union| on their full sets."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int, hashes: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, written to the shared folder; sets: id, sig, hashes."""
    spread = (num / den * (1 - num / den) / hashes) ** 0.5
    sig, full = sets.select("id", "sig"), sets.select("id", "hashes")
    near = (
        pairs.join(sig.toDF("a", "sig_a"), "a")
        .join(sig.toDF("b", "sig_b"), "b")
        .mapInArrow(_resembling(num / den - 6 * spread), "a long, b long")
    )
    return materialize(near.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b").mapInArrow(_confirmed(num, den), "a long, b long"))


def _between(members: DataFrame, num: int, den: int, bits: int) -> DataFrame:
    """Pairs (a, b) of one small bucket but different components whose sizes and low bits allow the similarity.

    members: key, id, comp, n, low1, low2.  Of bits low bits, those of a linked pair differ in (1 - similarity) / 2;
    4.5 standard deviations more are let through.
    """
    differ = (1 - num / den) / 2
    most = int(bits * differ + 4.5 * (bits * differ * (1 - differ)) ** 0.5)
    left, right = (members.select("key", *(F.col(c).alias(c + side) for c in ("id", "comp", "n", "low1", "low2"))) for side in "ab")
    similar = f"ida < idb and compa <> compb and {den} * least(na, nb) >= {num} * greatest(na, nb) and bit_count(low1a ^ low1b) + bit_count(low2a ^ low2b) <= {most}"
    return left.join(right, "key").filter(similar).select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()


def _block_links(num: int, den: int):
    """Links between the members of two blocks of a cluster (or within one), of different components."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("id").sort_values(["bin", "block", "id"])
        sets = [np.frombuffer(x, U64) for x in group.hashes]
        size, ids, comp = np.array([len(x) for x in sets]), group.id.to_numpy(), group.comp.to_numpy()
        word, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        first = (group.bin.to_numpy() == key[1]) & (group.block.to_numpy() == key[2])
        x, y = np.flatnonzero(first), np.flatnonzero(first if key[1:3] == key[3:5] else ~first)
        both = np.zeros((len(x), len(y)), np.float32)
        for lo in range(0, len(word), 1024):
            part = slice(*np.searchsorted(at, [lo, lo + 1024]))
            has = np.zeros((len(sets), 1024), np.float32)
            has[row[part], at[part] - lo] = 1
            both += has[x] @ has[y].T
        both = both.astype(np.int64)
        ok = (den * both >= num * (size[x][:, None] + size[y][None, :] - both)) & (comp[x][:, None] != comp[y][None, :]) & (ids[x][:, None] != ids[y][None, :])
        i, j = np.nonzero(ok)
        return pd.DataFrame({"a": np.minimum(ids[x[i]], ids[y[j]]), "b": np.maximum(ids[x[i]], ids[y[j]])})

    return run


def _clustered(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between different components of large buckets; members: key, id, comp.

    Members that large buckets join, directly or by others, are a cluster, so a document is in one cluster however many
    buckets it shares.  Its sets are dealt to bins by the logarithm of their size, so that linked ones are in equal or
    neighbouring bins, and to blocks of a bin; only blocks of such bins meet.
    """
    heads = materialize(members.groupBy("key").agg(F.min("id").alias("head")))
    cluster = components(members.join(heads, "key").select(F.col("head").alias("a"), F.col("id").alias("b")))
    comp = members.select("id", "comp").distinct()
    # a little wider than the logarithm asks for, so that rounding parts no pair
    size = F.floor(F.log(F.octet_length("hashes") / 8) / F.lit(1.0001 * np.log(den / num))).cast("int")
    placed = materialize(cluster.join(comp, "id").join(sets.select("id", "hashes"), "id").withColumn("bin", size))
    blocks = materialize(placed.groupBy("component", "bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    above = blocks.select("component", (F.col("bin") - 1).alias("bin"), F.col("blocks").alias("above"))
    below = blocks.select("component", (F.col("bin") + 1).alias("bin"), F.col("blocks").alias("below"))
    placed = placed.join(blocks.join(above, ["component", "bin"], "left").join(below, ["component", "bin"], "left"), ["component", "bin"])
    placed = placed.withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    meet = F.expr(
        "concat(transform(sequence(0, blocks - 1), x -> struct(bin as low, least(block, x) as i, bin as high, greatest(block, x) as j)),"
        " if(above is null, array(), transform(sequence(0, above - 1), x -> struct(bin as low, block as i, bin + 1 as high, x as j))),"
        " if(below is null, array(), transform(sequence(0, below - 1), x -> struct(bin - 1 as low, x as i, bin as high, block as j))))"
    )
    dealt = placed.withColumn("meet", F.explode(meet)).select("component", "meet.low", "meet.i", "meet.high", "meet.j", "bin", "block", "id", "comp", "hashes")
    return dealt.groupBy("component", "low", "i", "high", "j").applyInPandas(_block_links(num, den), "a long, b long").distinct()


def _members(bucketed: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, id, comp) of all buckets with the components of the links so far."""
    return bucketed.select("key", "id").join(comp.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _joined(comp: DataFrame, found: DataFrame) -> DataFrame:
    """Components of the stars comp and the new links."""
    return components(comp.toDF("a", "b").unionByName(found))


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, bands: int = 34, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, group_id, kept) for every row of docs(doc_id, text).

    text_hash is xxhash64 of the text; group_id is one number for all rows of a component, and null without a set.

    Words are runs without white space (space, tab to carriage return), A-Z lower-cased; a set holds the distinct
    shingles of size words.  Documents with den * |A and B| >= num * |A or B| are linked.  Null or wordless texts
    have no set and no link; repeated rows share a component; an empty table gives an empty result.  Rows of one doc_id with
    different texts are judged each by its own text, and may be in components of different names; a row is kept where its
    own doc_id names its component.  A row with a null doc_id keeps it and stands alone, undecided (component_id null, kept null).
    A pair at the threshold s is missed with probability (1 - s^rows)^bands: 2e-6 at 0.8 and the defaults.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    minima = Minima(bands, rows)
    profiles = materialize(docs.mapInArrow(_profile(size, minima), "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, low1 long, low2 long, bands array<long>, sig binary"))
    print_ = ["f1", "f2", "n_shingles"]
    some = profiles.filter("n_shingles > 0 and doc_id is not null")
    # of equal sets minima and bands are equal too, so any row's will do
    classes = materialize(some.groupBy(*print_).agg(F.min("doc_id").alias("rep")).withColumn("id", F.monotonically_increasing_id()))
    reps = some.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *print_])
    reps = materialize(reps.select("id", "doc_id", *print_, "bands", "sig", "low1", "low2").dropDuplicates(["id"]))

    keys = reps.select("id", F.explode("bands").alias("key"))
    heads = materialize(keys.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter("head < last"))
    bucketed = materialize(keys.join(heads, "key"))
    wanted = materialize(reps.select("id", "doc_id", *print_, "sig").join(bucketed.select("id"), "id", "left_semi"))
    texts = docs.join(wanted.select("doc_id"), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(size), "f1 long, f2 long, n_shingles long, hashes binary").groupBy(*print_).agg(F.first("hashes").alias("hashes"))  # rows may be repeated
    sets = materialize(sets.join(wanted.drop("doc_id"), print_).select("id", "sig", "hashes"))
    pair = [F.struct(F.col("head").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("last").alias("b"))][: 1 + ROUNDS]
    tested = materialize(bucketed.select(F.explode(F.array(*pair)).alias("pair")).select("pair.*").filter("a < b").distinct())
    comp = components(_links(tested, sets, num, den, bands * rows))
    shape = reps.select("id", F.col("n_shingles").alias("n"), "low1", "low2")
    members = _members(bucketed, comp)
    mixed = materialize(members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).filter("lo <> hi").select("key", "members"))
    members = materialize(members.join(mixed, "key"))
    pairs = _between(members.filter(F.col("members") <= BUCKET).join(shape, "id"), num, den, min(128, bands * rows))
    more = materialize(pairs.join(tested, ["a", "b"], "left_anti"))
    found = _links(more, sets, num, den, bands * rows)
    large = members.filter(F.col("members") > BUCKET)
    if not large.isEmpty():
        found = found.unionByName(_clustered(large, sets, num, den))
    comp = _joined(comp, found)

    known = materialize(classes.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")))
    least = known.groupBy("component").agg(F.min("rep").alias("least"))
    by_print = materialize(known.join(least, "component").select(*print_, "least", F.col("component").alias("group_id")))
    return profiles.select("doc_id", "text_hash", *print_).join(by_print, print_, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"),
        "text_hash",
        "group_id",
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract: three words a shingle, similarity of 85 in 100."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, num=85, den=100, bands=26, rows=5)
