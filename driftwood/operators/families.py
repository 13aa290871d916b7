"""Near-duplicate texts and the families that they form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.operators.graph import components
from driftwood.sources.scratch import checkpointed

#: Minima of a band, and how often at most a pair just at the asked similarity shares no band.
BAND, MISSED = 4, 1e-6


def bands(least: float) -> int:
    """The bands that a pair of similarity least all misses with a probability of at most MISSED: 51 at 0.7, 27 at 0.8."""
    return 1 if least >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(least**BAND)))


#: Texts and shingles of a block, about; two blocks' sets are what a task holds to compare their candidates.
BLOCK, SHINGLES = 2048, 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers after which their order is as good as random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted hashes of the distinct character shingles of a text."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h, done = code, 1  # of done characters; doubled, so long as it fits, for each bit of size
    power = np.uint64(0x9E3779B97F4A7C15)
    times = lambda k: np.uint64(pow(int(power), k, 1 << 64))
    for bit in bin(size)[3:]:
        h, done = h[: len(h) - done] * times(done) + h[done:], 2 * done
        if bit == "1":
            h, done = h[:-1] * power + code[done:], done + 1
    h = np.sort(mixed(h))
    return h[np.append(True, h[1:] != h[:-1])]


#: Texts of a batch of rows that leaves a task.
BATCH = 512


def _shingled(size: int, of):
    """(id, m, n, s): the number of distinct shingles of each text and of(their hashes); a text's shingles are dropped before the next one's are made."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                sets = [(len(h), of(h).view(np.int64)) for h in (shingles(t.as_py(), size) for t in part.column("text"))]
                n, keys = zip(*sets, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("m"), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "m", "n", "s"])

    return run


def _keys(count: int):
    """The keys of count bands of minima of a set of sorted hashes.

    A hash falls into one of as many equal ranges as there are minima, and a range's minimum is its least; ranges that stay empty are filled by the
    hashes mixed anew, round by round.  So each minimum is that of a random order of the set, as with a hash function of its own, but made at once.
    """
    bins = count * BAND
    starts = np.arange(bins, dtype=np.uint64) * np.uint64((1 << 64) // bins)

    def of(h):
        least, empty, k = np.zeros(bins, np.uint64), np.ones(bins, bool), 0
        while empty.any():
            now = np.sort(mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))) if k else h
            at = np.searchsorted(now, starts)
            found = empty & (np.append(at[1:], len(now)) > at)
            least[found] = now[at[found]] + np.uint64(k)
            empty &= ~found
            k += 1
        keys = np.arange(1, count + 1, dtype=np.uint64)
        for r in range(BAND):
            keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + least[r::BAND]
        return keys

    return of


#: Numbers of a matrix of texts and shingles.
CELLS = 1 << 22


def shared_counts(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """[row, column]: how many values the sets of a row and of a column have in common, by products of their incidence, some values at a time."""
    flat = [np.concatenate(sets) for sets in (rows, columns)]
    owner = [np.repeat(np.arange(len(sets)), [len(s) for s in sets]) for sets in (rows, columns)]
    values = np.sort(flat[0])
    values = values[np.append(True, values[1:] != values[:-1])]
    both = np.zeros(len(values) + 1, bool)
    both[(at := np.searchsorted(values, flat[1]))[np.append(values, 0)[at] == flat[1]]] = True
    values = values[both[:-1]]
    out = np.zeros((len(rows), len(columns)), np.float32)
    if not len(values):
        return out
    placed = []
    for f, o in zip(flat, owner, strict=True):
        at = np.minimum(np.searchsorted(values, f), len(values) - 1)
        use = values[at] == f
        at, o = at[use], o[use]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], o[order]))
    step = max(1, CELLS // max(out.shape))
    for low in range(0, len(values), step):
        parts = []
        for (at, o), n in zip(placed, out.shape, strict=True):
            a, b = np.searchsorted(at, [low, low + step])
            m = np.zeros((n, min(step, len(values) - low)), np.float32)
            m[o[a:b], at[a:b] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def ties(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, heads): every node of a symmetric matrix of links that reaches an earlier one, and the first node that it reaches."""
    left, nodes, heads = link.any(1), [], []
    for head in np.flatnonzero(left):
        if left[head]:
            left[head], front = False, np.array([head])
            while len(front):
                front = np.flatnonzero(link[front].any(0) & left)
                left[front] = False
                nodes.append(front)
                heads.append(np.full(len(front), head))
    return (np.concatenate(nodes), np.concatenate(heads)) if nodes else (np.zeros(0, int), np.zeros(0, int))


def copy_classes(texts: DataFrame, shortest: int = 500) -> DataFrame:
    """(id, rep, copies) of every text of at least shortest characters: the least id of its equals, and how many they are."""
    long = texts.filter(F.length("text") >= shortest).select("id", F.md5("text").alias("m"))
    return long.join(long.groupBy("m").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "m").select("id", "rep", "copies")


def with_copies(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, jaccard) with a < b between all texts: pairs of representatives dealt to their copies, and equal texts at 1."""
    side = lambda rep, name: classes.select(F.col("rep").alias(rep), F.col("id").alias(name))
    apart = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    many = classes.filter("copies > 1")
    equal = many.select("rep", F.col("id").alias("a")).join(many.select("rep", F.col("id").alias("b")), "rep").filter("a < b")
    return apart.unionByName(equal.select("a", "b", F.lit(1.0).alias("jaccard")))


def flagged_twins(flags: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, near_flag) of every text that has a near or exact copy: whether any of them has its flag; flags(id, flag).

    Flags are counted for each class, so classes are never dealt out into pairs.
    """
    own = classes.join(flags, "id")
    counts = own.groupBy("rep").agg(F.count_if("flag").alias("n"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    near = both.join(counts.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    return _flagged(own, counts, near)


def flagged_near(texts: DataFrame, flags: DataFrame, least: float) -> DataFrame:
    """flagged_twins of the near copies at least of texts(id, text), which are never made as pairs."""
    own = copy_classes(texts).join(flags, "id")
    counts = checkpointed(own.groupBy("rep").agg(F.count_if("flag").alias("n")))
    near = near_copies(texts, least, counts.select(F.col("rep").alias("id"), "n"), sums=("n",))
    return _flagged(own, counts, linked(near, sums=("n",)).select(F.col("id").alias("rep"), F.col("n").alias("near")))


def _flagged(own: DataFrame, counts: DataFrame, near: DataFrame) -> DataFrame:
    seen = own.join(counts.join(near, "rep", "left"), "rep").filter((F.col("copies") > 1) | F.col("near").isNotNull())
    others = F.col("n") - F.coalesce(F.col("flag"), F.lit(False)).cast("int") > 0
    return seen.select("id", (others | (F.coalesce("near", F.lit(0)) > 0)).alias("near_flag"))


def _meetings(texts: DataFrame, least: float, size: int, shortest: int) -> DataFrame:
    """(low, high, side, id, n): the texts of each pair of blocks that have candidates for each other; side is whether a text is of the second one.

    Equal texts meet as one representative, the least id; copy_classes has the others.  Candidates agree in a band of minimum hashes, which a pair at
    least misses about once in a million times, and their sets are of like sizes.  A text's home is the least text of the largest bucket that it is
    in; homes are cut into blocks.  Buckets never make pairs: a text is told the blocks that its bucket has, and the same meeting once.
    """
    long = texts.filter(F.length("text") >= max(shortest, size)).select("id", "text", F.md5("text").alias("m"))
    sets = checkpointed(long.mapInArrow(_shingled(size, _keys(bands(least))), "id long, m string, n long, s array<long>"))
    reps = sets.groupBy("m").agg(F.min("id").alias("id")).select("id")
    keys = sets.join(reps, "id", "left_semi").select("id", "n", F.explode("s").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("head")).filter("members > 1")
    held = checkpointed(keys.join(buckets, "key"))
    homes = checkpointed(held.groupBy("id").agg(F.first("n").alias("n"), F.max(F.struct("members", "key", "head"))["head"].alias("home")))
    parts = homes.groupBy("home").agg(F.ceil(F.greatest(F.sum("n") / SHINGLES, F.count("*") / BLOCK)).alias("parts"))
    place = homes.join(parts, "home").select("id", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    held = checkpointed(held.select("id", "n", "key").join(place, "id"))
    other = held.groupBy("key", F.col("block").alias("other")).agg(F.count("*").alias("texts"), F.min("n").alias("least"), F.max("n").alias("most"))
    like = (F.col("most") >= F.lit(least) * F.col("n") - 1e-9) & (F.col("n") >= F.lit(least) * F.col("least") - 1e-9)
    met = held.join(other, "key").filter(like & ((F.col("other") != F.col("block")) | (F.col("texts") > 1)))
    return met.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("side"), "id", "n").distinct()


def _compared(texts: DataFrame, least: float, of, schema: str, facts: DataFrame | None = None, size: int = 9, shortest: int = 500) -> DataFrame:
    """of(similarities [row, column], rows, columns, same) for each pair of blocks, whose whole sets (as 64-bit hashes) are compared there.

    A text travels once to each pair of blocks that has candidates of it, with its facts(id, ...).  In a block that meets itself
    rows and columns are the same, and no text is like itself.
    """
    met = checkpointed(_meetings(texts, least, size, shortest))
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, (met.agg(F.sum("n")).first()[0] or 0) // (2 * SHINGLES) + 1)
    met = met.select("low", "high", "side", "id") if facts is None else met.select("low", "high", "side", "id").join(facts, "id")
    met = met.join(texts.filter(F.length("text") >= shortest).select("id", "text"), "id").repartition(tasks, "low", "high")

    def compare(both: pd.DataFrame) -> pd.DataFrame:
        both = both.drop_duplicates("id")
        both["s"] = [shingles(t, size) for t in both.pop("text")]
        same = bool((both["low"] == both["high"]).iloc[0])
        rows, columns = (both, both) if same else (both[~both["side"]], both[both["side"]])
        if not len(rows) or not len(columns):
            return of(np.zeros((len(rows), len(columns)), np.float32), rows, columns, same)
        shared = shared_counts(list(rows["s"]), list(columns["s"])).astype(np.float64)
        n = [np.array([len(s) for s in side["s"]]) for side in (rows, columns)]
        alike = shared / (n[0][:, None] + n[1] - shared)
        if same:
            np.fill_diagonal(alike, 0)
        return of(alike, rows, columns, same)

    return met.groupBy("low", "high").applyInPandas(compare, schema)


def near_duplicate_pairs(texts: DataFrame, least: float, size: int = 9, shortest: int = 500) -> DataFrame:
    """(a, b, jaccard) with a < b: Jaccard similarity of the distinct character shingles of texts(id, text) of at least shortest characters.

    Of equal texts one representative, the least id; copy_classes has the others.  A group of near copies makes all its pairs; near_copies sums them up.
    """

    def of(alike, rows, columns, same):
        i, j = np.nonzero(np.triu(alike >= least) if same else alike >= least)
        a, b = rows["id"].to_numpy()[i], columns["id"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "jaccard": alike[i, j]})

    return _compared(texts, least, of, "a long, b long, jaccard double", size=size, shortest=shortest)


def near_copies(texts: DataFrame, least: float, facts: DataFrame, sums: tuple = (), most: tuple = (), tied: tuple = (), shortest: int = 500) -> DataFrame:
    """What near_duplicate_pairs would give, summed up where the texts meet, for linked() and tied_at(); facts(id, ...) of every representative.

    Of each pair of blocks, for each text with links there: sums and maxima of the facts of those; and for each similarity in tied at most as many ties
    (a, b) as there are texts, which connect what the links connect.  Checkpointed.
    """
    names = [*sums, *most]

    def of(alike, rows, columns, same):
        out = []
        for side, others, link in ((rows, columns, alike >= least), (columns, rows, alike.T >= least))[: 1 if same else 2]:
            at = np.flatnonzero(link.any(1))
            link, found = link[at], {"id": side["id"].to_numpy()[at], "other": pd.array([pd.NA] * len(at), "Int64")}
            for c in sums:
                found[c] = link.astype(np.float64) @ others[c].to_numpy(np.float64)
            for c in most:
                found[c] = np.array([others[c].to_numpy(np.float64)[k].max() for k in link]) if len(at) else np.zeros(0)
            out.append(pd.DataFrame(found))
        ids = rows["id"].to_numpy() if same else np.concatenate([rows["id"], columns["id"]])
        for t in tied:
            link = alike >= t
            if not same:
                link = np.block([[np.zeros((len(rows),) * 2, bool), link], [link.T, np.zeros((len(columns),) * 2, bool)]])
            a, b = ties(link)
            out.append(pd.DataFrame({"id": ids[a], "other": pd.array(ids[b], "Int64"), "at": t}))
        return pd.concat(out).reindex(columns=["id", "other", "at", *names])

    return checkpointed(_compared(texts, least, of, ", ".join(["id long, other long, at double", *(f"`{c}` double" for c in names)]), facts, shortest=shortest))


def linked(near: DataFrame, sums: tuple = (), most: tuple = ()) -> DataFrame:
    """(id, ...) of every representative that has a near copy: the sums and maxima of near_copies over all of them."""
    return near.filter("other is null").groupBy("id").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in most))


def tied_at(near: DataFrame, least: float) -> DataFrame:
    """(a, b) that connect the representatives which links of at least this similarity connect."""
    return near.filter(F.col("at") == least).select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()


def link_numbers(texts: DataFrame, least: float, shortest: int = 500) -> DataFrame:
    """(id, component_id, n_links, copy_of) of every text: the least id that links of at least this similarity reach, the texts linked directly (equal
    ones among them), and the least id of its equals.  Texts of fewer than shortest characters link with nothing."""
    classes = checkpointed(copy_classes(texts, shortest))
    near = near_copies(texts, least, classes.filter("id = rep").select("id", "copies"), sums=("copies",), tied=(least,), shortest=shortest)
    reached = components(classes.filter("id = rep").select("id"), tied_at(near, least))
    links = linked(near, sums=("copies",))
    per = reached.join(links, "id", "left").select(F.col("id").alias("rep"), "component", F.coalesce("copies", F.lit(0.0)).cast("long").alias("near"))
    out = texts.select("id").join(classes.join(per, "rep"), "id", "left")
    return out.select("id", F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("near") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("rep", "id").alias("copy_of"))


def rescued(scores: DataFrame, texts: DataFrame, least: float, shortest: int = 500) -> DataFrame:
    """scores(id, label, score, ...) with twin, twin_score and normal_twin: whether a text has a near or exact copy, the greatest score of it and
    all its copies, and whether a copy other than it has no label.  Copies are those of texts(id, text) that have a score.

    Scores and labels are summed up for each class of equal texts, and where classes meet, so neither are ever dealt out into pairs.
    """
    own = copy_classes(texts, shortest).join(scores, "id")
    of_class = checkpointed(own.groupBy("rep").agg(F.max("score").alias("most"), F.count_if(~F.col("label")).alias("normal")))
    near = near_copies(texts, least, of_class.withColumnRenamed("rep", "id"), sums=("normal",), most=("most",), shortest=shortest)
    near = linked(near, ("normal",), ("most",)).select(F.col("id").alias("rep"), F.col("most").alias("near_most"), F.col("normal").alias("near_normal"))
    facts = own.select("id", "rep", "copies", "label").join(of_class, "rep").join(near, "rep", "left")
    others = F.col("normal") - (~F.col("label")).cast("int") > 0
    facts = facts.select("id", ((F.col("copies") > 1) | F.col("near_most").isNotNull()).alias("twin"), F.greatest("most", "near_most").alias("twin_score"), (others | (F.coalesce("near_normal", F.lit(0.0)) > 0)).alias("normal_twin"))
    out = scores.join(facts, "id", "left")
    return out.withColumns({"twin": F.coalesce("twin", F.lit(False)), "twin_score": F.greatest("score", "twin_score"), "normal_twin": F.coalesce("normal_twin", F.lit(False))})


def families(rows: DataFrame, keys: list[Column], pairs: DataFrame) -> DataFrame:
    """(id, campaign_id, campaign_size): rows(id) tied by equal keys (nulls tie nothing) or by pairs(a, b)."""
    edges = pairs.select("a", "b")
    for k in keys:
        heads = rows.filter(k.isNotNull()).groupBy(k.alias("k")).agg(F.min("id").alias("a"))
        edges = edges.union(rows.filter(k.isNotNull()).select(k.alias("k"), F.col("id").alias("b")).join(heads, "k").select("a", "b"))
    comp = components(rows.select("id"), edges)
    sizes = comp.groupBy("component").agg(F.count("*").alias("campaign_size"))
    name = F.concat(F.lit("c_"), F.left(F.sha2(F.col("component").cast("string"), 256), F.lit(10)))
    return comp.join(sizes, "component").select("id", name.alias("campaign_id"), "campaign_size")
