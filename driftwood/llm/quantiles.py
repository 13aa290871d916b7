"""Mergeable quantile summaries: error-bounded splines of the cumulative counts.

A summary is n and its knots (x, below, upto): how many values lie below x and up to x.  Between knots the count is a straight
line; a knot with below < upto is a double knot, a jump.  A shrinking cone decides greedily where the next knot must be, so that
no count is off by more than a share of n; this needs at most 1 / share + 2 knots.  At least LEAST distinct values stay knots,
or all that there are.  Summaries merge by adding their piecewise counts at all their knots and fitting anew; the
errors add up, see SHARES.  A quantile is the inverse of the summary.

Values are counted first, dealt over range partitions and summed up in chunks, so a hot group lies in many tasks.  What is
merged afterwards are summaries, at most FAN of a group in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftwood.llm.common import materialize, table

#: Knots that a summary keeps at least (if it has so many distinct values) and at most (if it has so many rows).
LEAST, MOST = 20, 2000
#: Distinct values that are fitted at once; summaries that are merged at once.
CHUNK, FAN = 1 << 16, 64
#: Share of n by which a fit of values, of parts of a group, of a batch and of merged batches may be off.  A value passes one fit, at
#: most five fits of parts (FAN^5 chunks), one of a batch and one of batches: 0.49 % in all, less than half of the 1 % that is promised.
SHARES = {"values": 0.0008, "parts": 0.0004, "batch": 0.0007, "batches": 0.0014}
QUANTILES = 20

KNOTS = "array<struct<x:bigint,below:double,upto:double>>"


def fit(x: np.ndarray, below: np.ndarray, upto: np.ndarray, error: float, least: int = LEAST) -> np.ndarray:
    """Indices of the knots: between two of them the line from upto of one to below of the next is within error of both counts."""
    n = len(x)
    if n <= least or float((upto - below).min()) > 2 * error:  # every value is a jump that no line may pass
        return np.arange(n)
    knots, xs, bs, us = [0], x.tolist(), below.tolist(), upto.tolist()
    x0, u0, low, high = xs[0], us[0], -np.inf, np.inf
    for j in range(1, n):
        run = xs[j] - x0
        if not low <= (bs[j] - u0) / run <= high:
            knots.append(j - 1)
            x0, u0, low, high = xs[j - 1], us[j - 1], -np.inf, np.inf
            run = xs[j] - x0
        low, high = max(low, (us[j] - error - u0) / run), min(high, (bs[j] + error - u0) / run)
    knots.append(n - 1)
    if len(knots) < least:  # too straight: knots from evenly spread values
        left = np.setdiff1d(np.arange(n), knots)
        knots = np.union1d(knots, left[np.linspace(0, len(left) - 1, least - len(knots)).astype(int)])
        spare = np.setdiff1d(left, knots)
        knots = np.union1d(knots, spare[: max(0, least - len(knots))])
    return np.asarray(knots, dtype=int)


Summary = tuple[np.ndarray, np.ndarray, np.ndarray]


def added(summaries: Summary, starts: np.ndarray) -> Summary:
    """The sum of the piecewise counts of summaries that lie one behind the other, at all their knots: jumps add up, and so do slopes."""
    x, below, upto = summaries
    slope = np.zeros(len(x))
    run = np.diff(x).astype(float)
    inner = np.ones(len(x) - 1, dtype=bool)
    inner[starts[1:] - 1] = False
    slope[:-1] = np.where(inner, (below[1:] - upto[:-1]) / np.where(inner, run, 1.0), 0.0)
    turn = slope.copy()
    turn[1:] -= np.where(inner, slope[:-1], 0.0)
    order = np.argsort(x, kind="stable")
    at, first = np.unique(x[order], return_index=True)
    jump = np.add.reduceat((upto - below)[order], first)
    slopes = np.maximum(np.cumsum(np.add.reduceat(turn[order], first)), 0.0)
    rise = np.concatenate(([0.0], slopes[:-1] * np.diff(at)))
    total = np.cumsum(jump + rise)
    return at, total - jump, total


def merged(summaries: Summary, starts: np.ndarray, share: float) -> Summary:
    """One summary of all: the counts of each are added at the knots of all, and a spline is fitted to the sum."""
    if len(starts) == 1:
        return summaries
    x, below, upto = added(summaries, starts)
    k = fit(x, below, upto, share * upto[-1])
    return x[k], below[k], upto[k]


def joined(summaries: list[Summary], share: float) -> Summary:
    return merged(tuple(np.concatenate([s[k] for s in summaries]) for k in range(3)), np.cumsum([0] + [len(s[0]) for s in summaries[:-1]]), share)


def inverse(summary: Summary, ranks: np.ndarray) -> np.ndarray:
    """For each rank the least whole x whose count reaches it up to a half: off by no more than the counts are, and exact where these are off by less than a half."""
    x, below, upto = summary
    want = ranks - 0.5
    k = np.minimum(np.searchsorted(upto, want, side="left"), len(x) - 1)
    a = np.maximum(k - 1, 0)
    rise = np.maximum(below[k] - upto[a], 1e-300)
    line = np.ceil(x[a] + (want - upto[a]) * (x[k] - x[a]) / rise)
    return np.where((k > 0) & (below[k] >= want), np.clip(np.nan_to_num(line), x[a], x[k]), x[k]).astype(np.int64)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys begin in a batch sorted by them."""
    change = np.zeros(batch.num_rows, dtype=bool)
    change[:1] = True
    for c in keys:
        codes = batch.column(c).dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _key(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(c)[row].as_py() for c in keys)


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that no group crosses, with the starts of their groups; a group as long as several batches is one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if held and _key(held[-1], keys, 0) != _key(batch, keys, 0):
            yield _one(held), np.array([0])
            held = []
        if held and len(starts) > 1:
            yield _one([*held, batch.slice(0, int(starts[1]))]), np.array([0])
            batch, starts, held = batch.slice(int(starts[1])), starts[1:] - starts[1], []
        if len(starts) > 1:
            yield batch.slice(0, int(starts[-1])), starts[:-1]
        held.append(batch.slice(int(starts[-1])))
    if held:
        yield _one(held), np.array([0])


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def _flat(lists: pa.Array) -> tuple[Summary, np.ndarray]:
    """All knots of a column of summaries, and where each summary begins (and the last ends)."""
    flat = lists.flatten()
    return tuple(flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)


def _rows(columns: list[pa.Array], keys: list[str], knots: Summary, ends: np.ndarray) -> pa.RecordBatch:
    """Summaries as rows (keys, n, knots)."""
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(knots[0].astype(np.int64)), pa.array(knots[1]), pa.array(knots[2])], names=["x", "below", "upto"]))
    n = pa.array(np.rint(knots[2][ends[1:] - 1]).astype(np.int64))
    return pa.RecordBatch.from_arrays([*columns, n, lists], names=[*keys, "n", "knots"])


def _single(batch: pa.RecordBatch, row: int, keys: list[str], s: Summary) -> pa.RecordBatch:
    return _rows([batch.column(c).slice(row, 1) for c in keys], keys, s, np.array([0, len(s[0])]))


def _small(batch: pa.RecordBatch, starts: np.ndarray, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Summaries of the groups of a batch, those of at most LEAST values all at once: their values are their knots."""
    ends = np.append(starts[1:], batch.num_rows)
    x, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("x", "c"))
    small = ends - starts <= LEAST
    if small.any():
        rows = np.repeat(small, ends - starts)
        size, c0 = (ends - starts)[small], c[rows]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        upto = np.cumsum(c0)
        upto = (upto - np.repeat(upto[first] - c0[first], size)).astype(float)
        columns = [batch.column(k).take(pa.array(starts[small])) for k in keys]
        yield _rows(columns, keys, (x[rows], upto - c0, upto), np.append(first, first[-1] + size[-1]))
    for a, b in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        upto = np.cumsum(c[a:b]).astype(float)
        k = fit(x[a:b], upto - c[a:b], upto, SHARES["values"] * upto[-1])
        yield _single(batch, a, keys, (x[a:b][k], (upto - c[a:b])[k], upto[k]))


def _parts(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """A summary of each group's values (x, c) in a task; a group of many batches is fitted in chunks, which are merged FAN at a time on each level."""
    held, n, levels, first = [], 0, {}, None

    def close_chunk() -> None:
        nonlocal held, n
        x, c = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in ("x", "c"))
        upto = np.cumsum(c).astype(float)
        k = fit(x, upto - c, upto, SHARES["values"] * upto[-1])
        levels.setdefault(0, []).append((x[k], (upto - c)[k], upto[k]))
        held, n, level = [], 0, 0
        while len(levels[level]) == FAN:
            levels.setdefault(level + 1, []).append(joined(levels[level], SHARES["parts"]))
            levels[level] = []
            level += 1

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal levels, first
        if held:
            close_chunk()
        yield _single(first, 0, keys, joined([s for level in levels.values() for s in level], SHARES["parts"]))
        levels, first = {}, None

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if first is not None:  # the group that the last batch ended with
            same = _key(first, keys, 0) == _key(batch, keys, 0)
            if same:
                upto = int(starts[1]) if len(starts) > 1 else batch.num_rows
                held.append(batch.slice(0, upto))
                n += upto
                batch, starts = batch.slice(upto), starts[1:] - upto
                if n >= CHUNK:
                    close_chunk()
            if not same or len(starts):
                yield from closed()
        if len(starts) > 1:
            yield from _small(batch.slice(0, int(starts[-1])), starts[:-1], keys)
        if len(starts):
            first = batch.slice(int(starts[-1]))
            held, n = [first], first.num_rows
    if first is not None:
        yield from closed()


def _merged(batches: Iterable[pa.RecordBatch], keys: list[str], share: float) -> Iterator[pa.RecordBatch]:
    """Rows (keys, n, knots) sorted by keys to one for each key; a row alone in its key passes as it is."""
    for batch, starts in _whole_groups(batches, keys):
        ends = np.append(starts[1:], batch.num_rows)
        alone = ends - starts == 1
        if alone.any():
            yield batch.take(pa.array(starts[alone])).select([*keys, "n", "knots"])
        if alone.all():
            continue
        knots, at = _flat(batch.column("knots"))
        found, sizes = [], []
        for a, b in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
            lo, hi = at[a], at[b]
            found.append(merged(tuple(k[lo:hi] for k in knots), at[a:b] - lo, share))
            sizes.append(len(found[-1][0]))
        columns = [batch.column(c).take(pa.array(starts[~alone])) for c in keys]
        yield _rows(columns, keys, tuple(np.concatenate([f[k] for f in found]) for k in range(3)), np.concatenate(([0], np.cumsum(sizes))))


def _schema(schema: StructType, keys: list[str]) -> str:
    return ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in keys) + f", n bigint, knots {KNOTS}"


def merge(summaries: DataFrame, keys: list[str], share: float = SHARES["batches"]) -> DataFrame:
    """One summary (keys, n, knots) of all that agree in keys; these should be few, as with batches, since they meet in one task."""
    dealt = summaries.select(*keys, "n", "knots").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda batches: _merged(batches, keys, share), _schema(summaries.schema, keys))


def summarise(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts(keys, x, c), each x once a group, to a summary (keys, n, knots) of each group.

    Keys may be null, which are equal then.  A group without rows has none.
    """
    part = "part_"
    dealt = counts.select(*keys, "x", F.col("c").cast("bigint").alias("c")).repartitionByRange(*keys, "x").sortWithinPartitions(*keys, "x")

    def build(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for b in _parts(batches, keys):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(np.full(b.num_rows, number, dtype=np.int64)), b.column("n"), b.column("knots")], names=[*keys, part, "n", "knots"])

    parts = materialize(dealt.mapInArrow(build, _schema(counts.schema, keys).replace(", n bigint", f", {part} bigint, n bigint")))
    last = parts.agg(F.max(part)).first()[0] or 0
    while last >= FAN:
        parts = merge(parts.withColumn(part, F.expr(f"{part} div {FAN}")), [*keys, part], SHARES["parts"])
        last //= FAN
    return merge(parts, keys, SHARES["batch"])


def answers(summaries: DataFrame, keys: list[str], quantiles: int = QUANTILES) -> DataFrame:
    """(keys, i, n, target, points, answer) for i in 1 .. quantiles - 1 of every summary of at least quantiles rows; target is ceil(i n / quantiles)."""
    steps = np.arange(1, quantiles)

    def ask(batches):
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(n >= quantiles)
            if not len(asked):
                continue
            knots, at = _flat(batch.column("knots"))
            targets = -(-steps[None, :] * n[asked][:, None] // quantiles)
            values = [inverse(tuple(v[at[k] : at[k + 1]] for v in knots), t) for k, t in zip(asked.tolist(), targets, strict=True)]
            repeat = np.repeat(asked, len(steps))
            columns = [batch.column(c).take(pa.array(repeat)) for c in keys]
            columns += [pa.array(np.tile(steps, len(asked)).astype(np.int32)), pa.array(n[repeat]), pa.array(targets.ravel().astype(np.int64)), pa.array(np.diff(at)[repeat]), pa.array(np.concatenate(values))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "i", "n", "target", "points", "answer"])

    schema = ", ".join(f"`{c}` {summaries.schema[c].dataType.simpleString()}" for c in keys) + ", i int, n bigint, target bigint, points bigint, answer bigint"
    return summaries.select(*keys, "n", "knots").mapInArrow(ask, schema)


_FOUND = ["n", "target", "exact_x", "points", "answer", "n_below", "n_upto"]


def _resolved(batch: pa.RecordBatch, starts: np.ndarray, keys: list[str], q: int) -> pa.RecordBatch | None:
    """The rows of the groups of a batch that hold all their values and answers; groups without answers give none."""
    size = np.diff(np.append(starts, batch.num_rows))
    kind, c, i, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("kind", "c", "i", "x"))
    group = np.repeat(np.arange(len(starts)), size)
    upto = np.cumsum(c)
    upto = upto - np.repeat(upto[starts] - c[starts], size)
    asks = np.zeros(len(starts), dtype=bool)
    asks[group[kind == 0]] = True
    if not asks.any():
        return None
    n = np.repeat(upto[np.append(starts[1:], batch.num_rows) - 1], size)
    value = (kind == 1) & asks[group]
    times = np.where(value, np.minimum(q - 1, q * upto // n) - q * (upto - c) // n, 0)
    exact = np.repeat(x, times)  # values come in order, so group by group and i by i
    ends = [np.flatnonzero(kind == k) for k in (0, 2)]
    below, above = (rows[np.lexsort((i[rows], group[rows]))] for rows in ends)
    columns = [batch.column(k).take(pa.array(below)) for k in (*keys, "i")]
    rows = {"n": n[below], "target": batch.column("target").to_numpy(zero_copy_only=False)[below], "exact_x": exact, "points": batch.column("points").to_numpy(zero_copy_only=False)[below], "answer": x[below], "n_below": upto[below], "n_upto": upto[above]}
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.asarray(rows[k]).astype(np.int64)) for k in _FOUND)], names=[*keys, "i", *_FOUND])


#: Rows of a group that a task holds back until the group ends; a longer one is finished by the sums of its parts.
HELD = 1 << 20


def audit(asked: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """asked (answers()) with exact_x, n_below and n_upto, exact, from counts(keys, x, c); an x may come in several rows.

    Values and answers are sorted together by range partitions, an answer once before and once behind its equals, so the running
    counts in front of them are n_below and n_upto.  A group that lies in one task is finished there.  The first and the last
    group of a task may go on in others: their running counts are written, and the sums of the tasks before are added.
    """
    q = QUANTILES
    zero = F.lit(0).cast("bigint")
    values = counts.select(*keys, "x", F.lit(1).alias("kind"), F.col("c").cast("bigint").alias("c"), F.lit(0).alias("i"), zero.alias("target"), zero.alias("points"))
    ends = asked.select(*keys, F.col("answer").alias("x"), F.explode(F.array(F.lit(0), F.lit(2))).alias("kind"), zero.alias("c"), "i", "target", "points")
    dealt = values.unionByName(ends).repartitionByRange(*keys, "x", "kind").sortWithinPartitions(*keys, "x", "kind")

    def run(batches):
        from pyspark import TaskContext

        number, open_key, sum_, held, n = TaskContext.get().partitionId(), None, 0, [], 0

        def out(b: pa.RecordBatch, upto: np.ndarray | None = None) -> pa.RecordBatch:
            """Rows of both kinds under one schema: finished ones, or open ones with their running counts."""
            nothing = pa.nulls(b.num_rows, pa.int64())
            if upto is None:
                columns = [*(b.column(k) for k in _FOUND), *[nothing] * 5]
            else:
                columns = [*[nothing] * len(_FOUND), *(b.column(k).cast(pa.int64()) for k in ("x", "kind", "c")), pa.array(upto), pa.array(np.full(b.num_rows, number, dtype=np.int64))]
            return pa.RecordBatch.from_arrays([*(b.column(k) for k in (*keys, "i")), *columns], names=[*keys, "i", *_FOUND, "x", "kind", "c", "upto", "part"])

        def opened(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal sum_
            upto = np.cumsum(b.column("c").to_numpy(zero_copy_only=False)) + sum_
            sum_ = int(upto[-1])
            return out(b, upto)

        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, keys)
            head = _key(batch, keys, 0)
            if not begun:
                begun, open_key = True, head
            if open_key is not None and open_key == head:
                upto = int(starts[1]) if len(starts) > 1 else batch.num_rows
                yield opened(batch.slice(0, upto))
                batch, starts = batch.slice(upto), starts[1:] - upto
                if not batch.num_rows:
                    continue
                head = _key(batch, keys, 0)
            open_key, sum_ = None, 0
            if held:
                if _key(held[0], keys, 0) == head:
                    upto = int(starts[1]) if len(starts) > 1 else batch.num_rows
                    held.append(batch.slice(0, upto))
                    n += upto
                    batch, starts = batch.slice(upto), starts[1:] - upto
                    if not batch.num_rows:
                        if n > HELD:
                            open_key = head
                            for b in held:
                                yield opened(b)
                            held, n = [], 0
                        continue
                done = _resolved(_one(held), np.array([0]), keys, q)
                held, n = [], 0
                if done is not None:
                    yield out(done)
            if len(starts) > 1:
                done = _resolved(batch.slice(0, int(starts[-1])), starts[:-1], keys, q)
                if done is not None:
                    yield out(done)
            held, n = [batch.slice(int(starts[-1]))], batch.num_rows - int(starts[-1])
        sum_ = 0
        for b in held:
            yield opened(b)

    kinds = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in keys)
    t = materialize(dealt.mapInArrow(run, f"{kinds}, i int, {', '.join(f'{c} bigint' for c in [*_FOUND, 'x', 'kind', 'c', 'upto', 'part'])}"))
    done, rest = t.filter("part is null").select(*keys, "i", *_FOUND), t.filter("part is not null").select(*keys, "i", "x", "kind", "c", "upto", "part")
    per = rest.groupBy(*keys, "part").agg(F.max("upto").alias("own"))
    whole = Window.partitionBy(*keys)
    per = per.withColumn("n", F.sum("own").over(whole)).withColumn("ahead", F.sum("own").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own"))
    per = per.withColumnsRenamed({c: f"p_{c}" for c in (*keys, "part")})
    on = F.col("part") == F.col("p_part")
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"p_{c}"))
    at = rest.join(per.drop("own").hint("merge"), on).withColumn("upto", F.col("upto") + F.col("ahead"))
    # a value is the target-th of those i with upto - c < ceil(i n / q) <= upto
    hit = at.filter("kind = 1").withColumns({"low": F.expr(f"({q} * (upto - c)) div n + 1"), "high": F.expr(f"least({q - 1}L, ({q} * upto) div n)")}).filter("low <= high")
    hit = hit.select(*keys, F.explode(F.expr("sequence(cast(low as int), cast(high as int))")).alias("i"), F.col("x").alias("exact_x"))
    ends = at.filter("kind <> 1").select(*keys, "i", F.when(F.col("kind") == 0, F.col("upto")).alias("n_below"), F.when(F.col("kind") == 2, F.col("upto")).alias("n_upto"))
    of_rest = asked.join(rest.select(*(F.col(c).alias(f"r_{c}") for c in keys)).distinct().hint("merge"), [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in keys], "left_semi")
    found = hit.unionByName(ends, allowMissingColumns=True).unionByName(of_rest, allowMissingColumns=True)
    found = found.groupBy(*keys, "i").agg(*(F.max(c).alias(c) for c in _FOUND)).filter("answer is not null").select(*keys, "i", *_FOUND)
    return done.unionByName(found)


BATCHES, OFFSET = 16, 1000


def _streams(spark, sf_dir: str) -> DataFrame:
    """(stream, grp, batch, x, c): how often each x occurs; lines meet their items as counts of each item and batch."""
    batch = F.pmod(F.crc32(F.coalesce(F.col("id"), F.lit("")).cast("string")), F.lit(BATCHES)).cast("int")
    x = F.floor(F.col("money") * 100 + 0.5).cast("bigint") + F.col("batch") * OFFSET
    whole = F.col("money").isNotNull() & ~F.isnan("money") & (F.abs("money") < 1e15)
    clicks = table(spark, sf_dir, "clicks").groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("row"))
    clicks = clicks.select(F.lit("value").alias("stream"), F.col("row.client_id").cast("string").alias("grp"), F.col("click_id").cast("string").alias("id"), F.col("row.value").alias("money"))
    clicks = clicks.filter(F.col("grp").isNotNull() & whole).withColumn("batch", batch)
    values = clicks.groupBy("stream", "grp", "batch", x.alias("x")).agg(F.count("*").alias("c"))
    lines = table(spark, sf_dir, "sale_lines").filter("item_id is not null").select("item_id", F.col("vendor_id").cast("string").alias("id")).withColumn("batch", batch)
    lines = lines.groupBy("item_id", "batch").agg(F.count("*").alias("c"))
    items = table(spark, sf_dir, "items").select("item_id", F.col("brand").alias("grp"), F.col("price").alias("money")).filter(F.col("grp").isNotNull() & whole)
    prices = lines.join(items.hint("merge"), "item_id").groupBy(F.lit("price").alias("stream"), "grp", "batch", x.alias("x")).agg(F.sum("c").alias("c"))
    return values.unionByName(prices)


def op12_quantile_splines(spark, sf_dir: str) -> DataFrame:
    """Twentieths of every batch's summary and of the merged summaries (batch -1), held against exact counts."""
    counts = materialize(_streams(spark, sf_dir))
    keys = ["stream", "grp", "batch"]
    batches = materialize(summarise(counts, keys))
    wholes = merge(batches, ["stream", "grp"]).withColumn("batch", F.lit(-1))
    asked = materialize(answers(batches.unionByName(wholes), keys))
    done = audit(asked, counts.unionByName(counts.withColumn("batch", F.lit(-1))), keys)
    error = F.greatest(F.lit(0).cast("bigint"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return done.withColumn("rank_error", error).withColumn("within", F.expr("1000 * rank_error <= 10 * n"))
