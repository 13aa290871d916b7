"""Dependency graphs, set-overlap joins and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.sources.scratch import checkpointed


def peer_pairs(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(q, r, shared): tokens that the sets of a query and of a reference share; both tables (id, token).

    Query by reference, never all by all: a hub token costs its queries times its references.
    """
    q = queries.select(F.col("id").alias("q"), "token").distinct()
    r = references.select(F.col("id").alias("r"), "token").distinct()
    return q.join(r, "token").groupBy("q", "r").agg(F.count("*").alias("shared"))


def has_peers(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Distinct query ids that share a token with a reference other than themselves; no pair is formed."""
    r = references.select(F.col("id").alias("r"), "token").distinct().groupBy("token").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    return queries.select("id", "token").distinct().join(r, "token").filter("lo <> hi or lo <> id").select("id").distinct()


#: Pairs of a task, and rows of sets, which it holds several times.
PAIRS, ROWS = 1_000_000, 200_000


def _dealt(sets: DataFrame, name: str) -> DataFrame:
    """The distinct (name, token) of sets(id, token), a set in one task and about ROWS rows in each."""
    rows = checkpointed(sets.select(F.col("id").alias(name), "token"))
    return rows.repartition(max(1, -(-rows.count() // ROWS)), name).distinct()


def _sets(queries: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(q, token, n, least) of queries, (r, token, nr) of references and (q, nq, known, last, alone, uses) of every query, as _overlaps has it."""
    q, r = _dealt(queries, "q"), _dealt(references, "r")
    r = checkpointed(r.join(r.groupBy("r").agg(F.count("*").alias("nr")), "r"))
    stats = r.groupBy("token").agg(F.count("*").alias("n"), F.min("nr").alias("least"))
    q = checkpointed(q.join(stats, "token", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    known = F.col("n") > 0
    per = q.groupBy("q").agg(F.count("*").alias("nq"), F.count_if(known).alias("known"), F.max(F.when(known, F.struct("n", "token"))).alias("top"), F.min("least").alias("least"))
    return q, r, checkpointed(per.select("q", "nq", "known", F.col("top.token").alias("last"), (1 / (F.col("nq") + F.col("least") - 1)).alias("alone"), F.col("top.n").alias("uses")))


def _pairs(q: DataFrame, r: DataFrame, per: DataFrame) -> DataFrame:
    """(q, r, shared, nq, nr) of the queries of per."""
    heads = q.filter("n > 0").join(per.select("q", "nq", "last"), "q").filter(F.col("token") != F.col("last"))
    # of all pairs that meet, which are counted first, a task has PAIRS
    parts = max(1, -(-(heads.agg(F.sum("n")).first()[0] or 0) // PAIRS))
    pairs = heads.select("q", "nq", "last", "token").join(r, "token").select("q", "r", "nq", "nr", "last").repartition(parts, "q", "r").groupBy("q", "r", "nq", "nr", "last").agg(F.count("*").alias("shared"))
    more = r.select("r", F.col("token").alias("last"), F.lit(1).alias("more")).repartition(parts, "r", "last")
    pairs = checkpointed(pairs).repartition(parts, "r", "last").join(more, ["r", "last"], "left")
    return pairs.select("q", "r", (F.col("shared") + F.coalesce("more", F.lit(0))).alias("shared"), "nq", "nr")


def _overlaps(queries: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(q, nq, known, last, alone, uses) of every query and (q, r, shared, nq, nr) of all pairs that share two tokens or more, and some that share one.

    Pairs meet on a query's tokens but its last, the one that most references have: who shares two tokens shares one of the others.  So
    a hub token, however many have it, makes no pair where it is the only one in common.  For that case a query knows
    alone, the best similarity that one shared token gives, from the least set that each token is in; uses is how many sets have its last token.
    """
    q, r, per = _sets(queries, references)
    return per, _pairs(q, r, per)


#: Tokens of a set that goes whole to where its tokens meet others.
WHOLE = 64


def max_jaccard(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(q, max_jaccard) of every query whose set shares a token with a reference's; tables (id, token).

    Sets of at most WHOLE tokens go to each of their tokens, where pairs are compared as they meet and a query keeps the best, so no pair is sent or
    written; pairs with a larger set are counted token by token.
    """
    q, r, per = _sets(queries, references)
    whole = q.join(per.filter(F.col("nq") <= WHOLE).select("q", "nq", "last"), "q").groupBy("q", "nq", "last").agg(F.collect_list("token").alias("mine"))
    heads = whole.select("q", "nq", "last", "mine", F.explode("mine").alias("token")).filter("token <> last")
    theirs = r.filter(F.col("nr") <= WHOLE).groupBy("r").agg(F.collect_list("token").alias("theirs")).select("theirs", F.explode("theirs").alias("token"))
    met = heads.join(theirs, "token").select("q", "nq", F.size("theirs").alias("nr"), F.size(F.array_intersect("mine", "theirs")).alias("shared"))
    better = lambda pairs: pairs.groupBy("q").agg(F.max(F.col("shared") / (F.col("nq") + F.col("nr") - F.col("shared"))).alias("best"))
    best, wide = better(met), r.filter(F.col("nr") > WHOLE)
    many = per.filter(F.col("nq") > WHOLE)
    more = [_pairs(q, r, many)] if not many.isEmpty() else []
    more += [_pairs(q, wide, per.filter(F.col("nq") <= WHOLE))] if not wide.isEmpty() else []
    if more:
        for pairs in more:
            best = best.unionByName(better(pairs))
        best = best.groupBy("q").agg(F.max("best").alias("best"))
    return per.filter("known > 0").join(best, "q", "left").select("q", F.greatest("alone", "best").alias("max_jaccard"))


def containment_support(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(q, support): references whose set contains the query's; tables (id, token)."""
    per, pairs = _overlaps(queries, references)
    found = pairs.filter("shared = nq").groupBy("q").agg(F.count("*").alias("found"))
    support = F.when(F.col("known") < F.col("nq"), 0).when(F.col("nq") == 1, F.col("uses")).otherwise(F.coalesce("found", F.lit(0)))
    return per.join(found, "q", "left").select("q", support.cast("bigint").alias("support"))


def number(df: DataFrame, key: str, name: str = "node", start: Column | int = 0) -> DataFrame:
    """df(key) with consecutive numbers in order of key: rank within range partitions, plus the rows of the partitions before."""
    ranged = checkpointed(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # of one row for each partition
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return ranged.withColumn("_r", rank).join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_r") + F.col("_o") + start).cast("bigint")).drop("_p", "_r", "_o")


def build(releases: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, node, is_context) and directed edges (src, dst).

    releases(name) are nodes in order of name; names that deps(name, dep) need and no release has are context nodes after them.
    """
    own = number(releases.select("name").distinct(), "name")
    deps = deps.join(own.select("name"), "name", "left_semi").filter("name <> dep").distinct()
    missing = deps.select(F.col("dep").alias("name")).distinct().join(own, "name", "left_anti")
    context = number(missing, "name", start=F.lit(own.count()))
    nodes = own.withColumn("is_context", F.lit(False)).unionByName(context.withColumn("is_context", F.lit(True)))
    src = nodes.select("name", F.col("node").alias("src"))
    dst = nodes.select(F.col("name").alias("dep"), F.col("node").alias("dst"))
    return nodes, deps.join(src, "name").join(dst, "dep").select("src", "dst")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("dst", "src")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_deg"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_deg"))
    return nodes.join(out, "node", "left").join(into, "node", "left").na.fill(0, ["out_deg", "in_deg"])


def profile_means(edges: DataFrame, features: DataFrame, value: str, least: int = 3) -> DataFrame:
    """(dst, n, mean): mean feature of a target's users, where it has at least least."""
    return edges.join(features, "src").groupBy("dst").agg(F.count("*").alias("n"), F.avg(value).alias("mean")).filter(F.col("n") >= least)


def leave_one_out(edges: DataFrame, features: DataFrame, value: str) -> DataFrame:
    """(src, dst, others): mean feature of the target's other users; 0 if there are none."""
    own = edges.join(features, "src")
    total = own.groupBy("dst").agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    return own.join(total, "dst").select("src", "dst", F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).otherwise(0.0).alias("others"))


def propagate_max(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, score): the greatest of a row's score and those of the rows that pairs(a, b) tie to it."""
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    near = both.join(scores.select(F.col("id").alias("b"), F.col("score").alias("_s")), "b").groupBy(F.col("a").alias("id")).agg(F.max("_s").alias("_near"))
    return scores.join(near, "id", "left").select("id", F.greatest("score", F.coalesce("_near", "score")).alias("score"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): least id reachable; nodes(id), edges(a, b).

    Alternating rounds hook every node to the least neighbour of its neighbours (large star) and shorten the paths
    (small star); each round is checkpointed, and rounds end when no edge changes.
    """
    e = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(hooked.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.expr("xxhash64(u, v) % 1000000007"))).first()
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("id"), F.col("v").alias("_c")), "id", "left").select("id", F.coalesce("_c", "id").alias("component"))
