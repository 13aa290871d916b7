"""Graph encoders: sampled neighbourhoods joined in Spark, small dense layers in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.functions.scalars import u01


def sampled(adjacency: DataFrame, fan_out: int, seed: str) -> DataFrame:
    """(node, neighbour): fan_out draws with replacement from adjacency(node, nb); a node without neighbours draws itself."""
    a = adjacency.select("node", "nb", F.explode(F.sequence(F.lit(0), F.lit(fan_out - 1))).alias("slot"))
    u = u01(F.concat_ws(":", F.lit(seed), F.col("node").cast("string"), F.col("slot").cast("string")))
    return a.select("node", F.when(F.size("nb") > 0, F.element_at("nb", (F.floor(u * F.size("nb")) + 1).cast("int"))).otherwise(F.col("node")).alias("neighbour"))


def weights(inputs: int, outputs: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).normal(0, inputs**-0.5, (inputs, outputs))


def gin_layer(nodes: DataFrame, draws: DataFrame, w: np.ndarray, size: int, eps: float = 0.0) -> DataFrame:
    """(id, x): relu(((1 + eps) own + mean of drawn neighbours) w), the node's own features behind it; nodes(id, x) of size features."""
    near = draws.join(nodes.select(F.col("id").alias("neighbour"), F.col("x").alias("xn")), "neighbour")
    summed = near.groupBy("node").agg(*(F.avg(F.col("xn")[k]).alias(f"m{k}") for k in range(size)))
    rows = nodes.join(summed.select(F.col("node").alias("id"), F.array(*(f"m{k}" for k in range(size))).alias("m")), "id")
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for b in batches:
            x, m = (np.array([np.asarray(v, float) for v in b[c]]).reshape(len(b), -1) for c in ("x", "m"))
            h = np.maximum(((1 + eps) * x + m) @ shared.value, 0) if len(b) else x
            yield pd.DataFrame({"id": b.id, "x": list(np.hstack((h, x)))})

    return rows.select("id", "x", "m").mapInPandas(run, "id long, x array<double>")


def svdd_scores(embedded: DataFrame, fit: DataFrame) -> DataFrame:
    """(id, score): squared distance to the centre of the fit rows' embeddings."""
    size = F.size("x")
    centre = fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))  # one row for each position
    d = F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return embedded.filter(size > 0).crossJoin(F.broadcast(centre)).select("id", d.alias("score"))
