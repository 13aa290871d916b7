"""Resamples as weights: draw j of resample b is a position by hash, so any engine draws the same."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256, shake_128

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions.scalars import u01
from driftwood.operators.graph import number
from driftwood.sources.scratch import checkpointed


def multiplicities(units: DataFrame, key: str, seed: str, resamples: int) -> DataFrame:
    """(b, key, times): how often each unit is drawn in resample b of as many draws as units, with replacement."""
    n = units.agg(F.count("*").alias("_all"))
    numbered = number(units.select(key), key, "_at")
    draws = numbered.crossJoin(n).select("_all", F.col("_at").alias("_j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(resamples - 1).cast("bigint"))).alias("b"))
    u = u01(F.concat_ws(":", F.lit(seed), F.col("b").cast("string"), F.col("_j").cast("string")))
    drawn = draws.select("b", F.floor(u * F.col("_all")).cast("bigint").alias("_at")).groupBy("b", "_at").agg(F.count("*").alias("times"))
    return drawn.join(numbered, "_at").select("b", key, "times")


#: Draws that a task looks up.
DRAWS = 1_000_000


def resampled_sums(units: DataFrame, key: str, seed: str, resamples: int) -> DataFrame:
    """(b, sums of all other columns of units) over the units drawn in each resample, as multiplicities draws them.

    Draws meet their units once, in as many tasks as their number asks for, and are summed up there.
    """
    values = [c for c in units.columns if c != key]
    numbered = number(units, key, "_at").drop(key)
    n = numbered.count()
    parts = max(1, -(-n * resamples // DRAWS))
    dealt = checkpointed(numbered.repartition(parts, "_at"))
    draws = dealt.select(F.col("_at").alias("_j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(resamples - 1).cast("bigint"))).alias("b"))
    u = u01(F.concat_ws(":", F.lit(seed), F.col("b").cast("string"), F.col("_j").cast("string")))
    drawn = draws.select("b", F.floor(u * F.lit(n)).cast("bigint").alias("_at")).repartition(parts, "_at")
    return drawn.join(dealt.repartition(parts, "_at"), "_at").groupBy("b").agg(*(F.sum(c).alias(c) for c in values))


#: Of 65536 equally likely numbers, how many give at most 0, 1, 2, ... draws: the distribution of Poisson's law of mean 1.
POISSON = [round(65536 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(8)]


#: Draws that each of the 65536 numbers stands for.
_TIMES = np.searchsorted(np.array(POISSON), np.arange(65536), side="right").astype(np.uint8)
#: Rows of a part, rows that a task takes at once, and numbers of a matrix that it holds; resamples of a block where there are many.
PART, ROWS, CELLS, MANY = 30_000, 512, 1 << 19, 128


def _mixed(z: np.ndarray) -> np.ndarray:
    """64-bit numbers of a counter-based generator (the finaliser of splitmix64), in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    return z


def drawn(keys: list[str], first: int, resamples: int, block: int = 16) -> np.ndarray:
    """[unit, resample] from resample first on, a multiple of block: how often the unit of a key is drawn, a keyed Poisson number known
    without the other units.  A block of resamples takes one hash, two bytes each: of sixteen, which SQL has too, or one as long as
    asked for.  From blocks of MANY on, a key is hashed once and mixed with the number of each four resamples, all at once.  The
    number of units in a resample varies by its square root.
    """
    if block >= MANY:
        own = np.frombuffer(b"".join(sha256(key.encode()).digest()[:8] for key in keys), "<u8")
        at = _mixed(np.arange(first // 4, -(-(first + resamples) // 4), dtype=np.uint64) + np.uint64(1))
        u = _mixed(own[:, None] + at).view(np.uint16)
        times = (u >= POISSON[0]).view(np.uint8)
        for least in POISSON[1:]:
            if least < 65536:
                times += (u >= least).view(np.uint8)
        return times[:, :resamples]
    blocks = range(first // block, -(-(first + resamples) // block))
    if block == 16:
        whole = b"".join(sha256(f"{k}:{key}".encode()).digest() for key in keys for k in blocks)
    else:
        whole = b"".join(shake_128(f"{k}:{key}".encode()).digest(2 * block) for key in keys for k in blocks)
    return _TIMES[np.frombuffer(whole, ">u2").reshape(len(keys), block * len(blocks))][:, :resamples]


def _pieces(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows sorted by s in pieces of about ROWS that no score crosses."""
    s, at = rows["s"].to_numpy(), 0
    while at < len(s):
        end = len(s) if at + ROWS >= len(s) else int(np.searchsorted(s, s[at + ROWS], side="left"))
        end = end if end > at else int(np.searchsorted(s, s[at], side="right"))
        yield rows.iloc[at:end]
        at = end


def _slices(resamples: int, rows: int, block: int) -> Iterator[tuple[int, int]]:
    step = max(block, CELLS // max(1, rows) // block * block)
    yield from ((a, min(step, resamples - a)) for a in range(0, resamples, step))


def _counts(times: np.ndarray) -> np.ndarray:
    """[0..rows, resample]: draws of the rows before; a row at a time, which is far faster than cumsum down the columns."""
    kind = np.uint16 if len(times) * len(POISSON) < 65536 else np.int64
    out, times = np.zeros((len(times) + 1, times.shape[1]), kind), times.astype(kind)
    for k in range(len(times)):
        np.add(out[k], times[k], out=out[k + 1])
    return out


def _sums(part: int, rows: pd.DataFrame, resamples: int, block: int) -> pd.DataFrame:
    """Weights of the positives (p) and negatives (n) of a part and the area among them, for its first score, its last, and those between."""
    s = rows["s"].to_numpy()
    out = {k: np.zeros((3, resamples)) for k in ("p", "n", "area")}
    for piece in _pieces(rows):
        value, pos = piece["s"].to_numpy(), piece["pos"].to_numpy()
        up, down, w = value[pos], value[~pos], piece["w"].to_numpy()[pos]
        codes, families = pd.factorize(piece["key"].to_numpy()[pos])
        singles = list(piece["key"].to_numpy()[~pos])
        lower, upper = np.searchsorted(down, up, side="left"), np.searchsorted(down, up, side="right")
        # where the positives and the negatives of each kind begin
        edges = lambda v: [0, np.searchsorted(v, s[0], side="right"), max(np.searchsorted(v, s[-1], side="left"), np.searchsorted(v, s[0], side="right")), len(v)]
        of_up, of_down = edges(up), edges(down)
        for a, m in _slices(resamples, len(piece), block):
            n = _counts(drawn(singles, a, m, block)) if singles else np.zeros((1, m), np.int64)
            weighed = drawn(list(families), a, m, block)[codes] * w[:, None] if len(w) else np.zeros((0, m))
            for k in range(3):
                x, y = of_up[k], of_up[k + 1]
                start = n[of_down[k]].astype(float)
                if x < y:
                    p = weighed[x:y].sum(0)
                    # negatives below, and half of those at the same score; outside the middle only the latter count
                    twice = np.einsum("ij,ij->j", weighed[x:y], n[lower[x:y]].astype(float)) + np.einsum("ij,ij->j", weighed[x:y], n[upper[x:y]].astype(float))
                    out["area"][k, a : a + m] += twice / 2 + p * ((out["n"][1, a : a + m] if k == 1 else 0.0) - start)
                    out["p"][k, a : a + m] += p
                out["n"][k, a : a + m] += n[of_down[k + 1]] - start
    b = np.arange(resamples)
    frames = [pd.DataFrame({"part": part, "kind": k, "s": s[0] if k < 2 else s[-1], "last": s[-1], "b": b, **{c: v[k] for c, v in out.items()}}) for k in range(3) if k == 0 or s[0] < s[-1]]
    return pd.concat(frames, ignore_index=True)


def _asked(rows: pd.DataFrame, asked: pd.DataFrame, found, of: bool, block: int) -> pd.DataFrame:
    """asked(b, at) with x = found(draws, scores, weights, at), over the positives or the negatives between a part's first and last score."""
    s = rows["s"].to_numpy()
    rows = rows[(s > s[0]) & (s < s[-1]) & (rows["pos"] == of)]
    asked = asked.assign(x=np.nan)
    codes, keys = pd.factorize(rows["key"])
    s, w = rows["s"].to_numpy(), rows["w"].to_numpy()
    for k, own in asked.groupby(asked["b"] // block):
        times = np.ascontiguousarray(drawn(list(keys), int(k) * block, block, block)[codes].T)
        asked.loc[own.index, "x"] = [found(times[b % block], s, w, at) for b, at in zip(own["b"], own["at"], strict=True)]
    return asked


def _score_at(times, s, w, at) -> float:
    return s[np.searchsorted(np.cumsum(times, dtype=np.int32), at, side="left")]


def _above(times, s, w, at) -> float:
    first = np.searchsorted(s, at, side="right")
    return float(times[first:] @ w[first:])


def bootstrap(scores: DataFrame, score: str, label: Column, weight: Column, family: Column, row: Column, resamples: int, fpr: float = 0.01, block: int = 16) -> DataFrame:
    """(b, auc, tpr) of each resample: the weighted area, and the weighted share caught at a false-positive rate, whose threshold is the
    resample's own.  Positives are drawn by family, negatives one by one.

    Rows are dealt over range partitions of about PART rows by score, and by their key where scores are equal, so no score is one
    task's.  A part draws its rows' weights for all resamples, some at a time, and sends sums for each resample: of its first score,
    its last, and those between.  These say where in the order a threshold lies; the parts in which thresholds do look them
    up, and then add up the positives above them.  No row is copied for a resample.
    """
    keyed = scores.select(
        F.col(score).cast("double").alias("s"), label.alias("pos"), weight.cast("double").alias("w"),
        F.when(label, F.concat(F.lit("family:"), family.cast("string"))).otherwise(F.concat(F.lit("row:"), row)).alias("key"),
    ).filter("s is not null and pos is not null and w is not null and key is not null")
    keyed = checkpointed(keyed)
    parts = max(1, -(-keyed.count() // PART))
    dealt = checkpointed(keyed.repartitionByRange(parts, "s", F.xxhash64("key")).withColumn("part", F.spark_partition_id()))

    def sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _sums(int(key[0]), rows.sort_values("s", kind="stable"), resamples, block)

    of_parts = checkpointed(dealt.repartition(parts, "part").groupBy("part").applyInPandas(sums, "part long, kind int, s double, last double, b int, p double, n double, area double"))
    # the first and last scores of parts are joined where equal; between, a part has its scores for itself
    ends = of_parts.filter("kind <> 1").groupBy("b", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).select("b", "s", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("part"), F.col("s").alias("last"), "p", "n", (F.col("p") * F.col("n") / 2).alias("area"))
    inner = of_parts.filter("kind = 1").select("b", "s", "kind", "part", "last", "p", "n", "area")
    own = Window.partitionBy("b")  # three rows a part
    order = own.orderBy("s", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segments = ends.unionByName(inner).withColumns({"upto": F.sum("n").over(order), "all_n": F.sum("n").over(own), "all_p": F.sum("p").over(own)})
    segments = checkpointed(segments.withColumn("ahead", F.col("upto") - F.col("n")))
    place = (F.col("all_n") - 1) * (1 - fpr)
    auc = segments.groupBy("b").agg(F.try_divide(F.sum(F.col("area") + F.col("p") * F.col("ahead")), F.first("all_p") * F.first("all_n")).alias("auc"), F.first(place).alias("place"), F.first("all_p").alias("all_p"))
    wanted = segments.withColumn("rank", F.explode(F.array(F.floor(place) + 1, F.floor(place) + 2))).filter("rank > ahead and rank <= upto").withColumn("which", F.col("rank") - F.floor(place))

    def lookup(asked: DataFrame, found, of: bool) -> DataFrame:
        """asked(part, b, at, which) with x."""

        def run(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(wanted):
                return wanted.assign(x=[])[["b", "which", "x"]]
            return _asked(rows.sort_values("s", kind="stable"), wanted.reset_index(drop=True), found, of, block)[["b", "which", "x"]]

        met = dealt.join(asked.select("part").distinct(), "part", "left_semi")
        return met.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(run, "b int, which long, x double")

    inside = lookup(wanted.filter("kind = 1").select("part", "b", (F.col("rank") - F.col("ahead")).alias("at"), "which"), _score_at, False)
    limits = wanted.filter("kind = 0").select("b", "which", F.col("s").alias("x")).unionByName(inside).groupBy("b").agg(F.max(F.when(F.col("which") == 1, F.col("x"))).alias("l"), F.max(F.when(F.col("which") == 2, F.col("x"))).alias("u"))
    limits = checkpointed(auc.join(limits, "b", "left").withColumn("q", F.col("l") + (F.col("place") - F.floor("place")) * (F.coalesce("u", "l") - F.col("l"))))
    cut = checkpointed(segments.join(limits.select("b", "q"), "b").filter("last > q or kind = 0 and s > q"))
    crossed = (F.col("kind") == 1) & (F.col("s") < F.col("q"))
    partly = lookup(cut.filter(crossed).select("part", "b", F.col("q").alias("at"), F.lit(0).cast("long").alias("which")), _above, True)
    hits = cut.filter(~crossed).select("b", F.col("p").alias("x")).unionByName(partly.select("b", "x")).groupBy("b").agg(F.sum("x").alias("hit"))
    return limits.join(hits, "b", "left").select("b", "auc", F.try_divide(F.coalesce("hit", F.lit(0.0)), "all_p").alias("tpr"))


def bootstrap_ci(scores: DataFrame, score: str, label: Column, weight: Column, family: Column, row: Column, resamples: int, fpr: float = 0.01, block: int = 16) -> DataFrame:
    """One row: 95 % intervals of the weighted area and of the weighted share caught at a false-positive rate, over all resamples."""
    both = bootstrap(scores, score, label, weight, family, row, resamples, fpr, block)  # a row for each resample
    return both.agg(*(F.percentile(c, q).alias(f"{c}_{name}") for c in ("auc", "tpr") for q, name in ((0.025, "lo"), (0.975, "hi"))), F.count("*").alias("resamples"))
