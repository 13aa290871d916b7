"""Repeated byte spans across all documents, by longest-previous-factor arrays.

A string of SPAN bytes contains SPAN - GRAM + 1 grams of GRAM bytes; the one of least hash (the leftmost of equals) is its
anchor, which depends on the string alone.  So the strings of all documents fall into groups by anchor, and equal strings
into the same group.  The strings of consecutive starts that share an anchor form a segment; only anchors that occur
twice go on.

1. Segments that are equal as a whole are counted (with map-side sums), however many there are.
2. A string contains its anchor with HALF bytes before it, or with HALF bytes behind it.  Distinct segments go on only
   where another one of their anchor has the same bytes there, which drops short common lines.
3. The distinct segments of an anchor meet in one suffix array, pooled with those of other anchors.  Over the suffix order,
   the previous and next smaller positions give each start its longest earlier match (LPF), the previous and next
   greater ones its longest later match.
4. An anchor with more than GROUP distinct segments isn't gathered: its segments are halved at fixed offsets from
   the anchor; equal halves are counted, and halves whose strings' common core occurs once are dropped, down to
   single strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import textkit as tk
from driftwood.llm.common import drop, materialize, table, tune

U64 = np.uint64
SPAN, GRAM = 200, 32
#: Distinct segments of one anchor that are gathered in one task, at most.
GROUP = 512
#: Bytes of one suffix array, about; bytes of one scan step.
POOL, STEP = 1 << 18, 1 << 19
KEY = ["doc_id", "h"]


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    """Least value of each run of window values, by doubling."""
    size = 1
    while 2 * size <= window:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = window - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, offs: np.ndarray, span: int, gram: int):
    """(document, anchor hash, segment hash, left hash, right hash, first start, last start, anchor) of the segments in data.

    Positions are within data.  The side hashes are 0 where no string of the segment has half the bytes on that side.
    """
    counts = np.maximum(np.diff(offs) - span + 1, 0)
    if not counts.any():
        return (np.zeros(0, U64),) * 8
    code = tk.prefix_code(data)
    _, down = tk.powers(len(code))
    g = tk.mix((code[gram:] - code[:-gram]) * down[: len(code) - gram])
    least = sliding_min(g, span - gram + 1)
    # runs of starts in one document whose windows have the same least gram
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    full = np.flatnonzero(counts)
    new[offs[full]] = True
    ends = offs[full] + counts[full]
    new[ends[ends < len(new)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    doc = np.searchsorted(offs, first, "right") - 1
    own = first < offs[doc] + counts[doc]
    first, last, doc = first[own], last[own], doc[own]
    out = []
    while len(first):
        anchor, todo = np.zeros(len(first), np.int64), np.arange(len(first))
        for k in range(span - gram + 1):
            here = first[todo] + k
            hit = g[here] == least[first[todo]]
            anchor[todo[hit]] = here[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        out.append((doc, first, np.minimum(last, anchor), anchor))
        again = last > anchor  # starts after the anchor have the next equal gram (periodic texts)
        first, last, doc = anchor[again] + 1, last[again], doc[again]
    doc, p1, p2, anchor = (np.concatenate(x) for x in zip(*out, strict=True))
    half = (span - gram) // 2
    sides = []
    for some, start, end in ((anchor - p1 >= half, anchor - half, anchor + gram), (anchor - p2 <= span - gram - half, anchor, anchor + gram + half)):
        side = np.zeros(len(p1), U64)
        side[some] = tk.span_hashes(code, start[some], end[some])
        sides.append(side)
    return doc, g[anchor], tk.span_hashes(code, p1, p2 + span), *sides, p1, p2, anchor


def _runs(column, step: int, span: int):
    """(first row, bytes, offsets, offset of the bytes in their document) for slices; a very long text comes in overlapping parts."""
    for lo, hi, data, offs in tk.slices(column, step):
        if len(data) <= 4 * step or hi > lo + 1:
            yield lo, data, offs, 0
            continue
        for s in range(0, len(data) - span + 1, step):
            part = data[s : s + step + span - 1]
            yield lo, part, np.array([0, len(part)]), s


def _scan(span: int, gram: int):
    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("h")
            for lo, data, offs, shift in _runs(batch.column("text"), STEP, span):
                doc, g, seg, left, right, p1, p2, a = segments(data, offs, span, gram)
                doc, p1, p2, a = (x.astype(np.int64) for x in (doc, p1, p2, a))
                row = pa.array(doc + lo)
                start = p1 - offs[doc] + shift
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), hashes.take(row), *(pa.array(x.view(np.int64)) for x in (g, seg, left, right)), pa.array(start), pa.array((a - p1) << 8 | (p2 - p1))],
                    ["doc_id", "h", "g", "seg", "left", "right", "start", "shape"],
                )

    return run


def _anchors(span: int, gram: int):
    def run(batches):
        for batch in batches:
            for _, data, offs, _ in _runs(batch.column("text"), STEP, span):
                yield pa.RecordBatch.from_arrays([pa.array(segments(data, offs, span, gram)[1].view(np.int64))], ["g"])

    return run


def _cut(span: int):
    """The bytes of the wanted segments of each document."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py().encode()
                want = batch.column("want")[i].as_py()
                own = [(w["g"], w["start"], w["shape"], w["single"], w["large"], text[w["start"] : w["start"] + (w["shape"] & 255) + span]) for w in want]
                cols = list(zip(*own, strict=True))
                row = pa.array([i] * len(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("h").take(row), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.binary())],
                    ["doc_id", "h", "g", "start", "shape", "single", "large", "bytes"],
                )

    return run


def suffix_order(data: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of span bytes at starts, and the length (up to span) that each shares with the one before."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    rank = np.zeros(len(data), U64)
    for j in range(8):
        rank = rank << U64(8) | padded[j : j + len(data)]
    levels, size = [], 8
    rank = np.unique(rank, return_inverse=True)[1].astype(U64)
    levels.append((8, rank))
    while 2 * size <= span:
        nxt = np.zeros(len(rank), U64)
        nxt[:-size] = rank[size:] + U64(1)
        rank = np.unique(rank << U64(32) | nxt, return_inverse=True)[1].astype(U64)
        size *= 2
        levels.append((size, rank))
    keys, done = [], 0
    for size, rank in reversed(levels):
        while done + size <= span:
            keys.append(rank[starts + done])
            done += size
    for j in range(done, span):
        keys.append(data[starts + j])
    order = np.lexsort(keys[::-1])
    a, b = starts[order[:-1]], starts[order[1:]]
    common = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        while True:
            fits = common + size <= span
            same = np.zeros(len(a), bool)
            same[fits] = rank[a[fits] + common[fits]] == rank[b[fits] + common[fits]]
            if not same.any():
                break
            common[same] += size
    for _ in range(8):
        fits = common < span
        same = np.zeros(len(a), bool)
        same[fits] = data[a[fits] + common[fits]] == data[b[fits] + common[fits]]
        common[same] += 1
    return order, np.concatenate(([0], common))


def longest_matches(order: np.ndarray, common: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Longest match of each start with an earlier and with a later one (starts are numbered by position); 0 if shorter than least.

    One sweep over the suffix order with a stack of positions: when a smaller position comes, it is the next smaller one of
    those it removes, and what then lies below it is its previous smaller one.  Negated positions give the later ones.
    """
    n = len(order)
    common = np.where(common >= least, common, 0)
    some = (common > 0) | np.append(common[1:] > 0, False)[:n]  # others match nothing, and are between no two that match
    shared, out = common[some].tolist(), []
    for positions in (order[some].tolist(), (n - 1 - order[some]).tolist()):
        best = [0] * (n + 1)
        stack: list[tuple[int, int]] = []  # (position, length shared with the entry below)
        for k in range(len(shared)):
            p, length = positions[k], shared[k]
            while stack and stack[-1][0] > p:
                q, below = stack.pop()
                best[q] = max(best[q], length)
                length = min(length, below)
            if stack:
                best[p] = max(best[p], length)
            stack.append((p, length))
        out.append(np.array(best[:n]))
    return out[0], out[1][::-1]


def _pooled(keep_first: bool, span: int):
    """Removed byte ranges of segments that come sorted by anchor, then document and start."""

    def solve(rows):
        rows = list({r[:4]: r for r in rows}.values())  # a repeated row is one document here
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))
        data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        sizes = np.array([len(r[6]) for r in rows])
        base = np.cumsum(sizes) - sizes
        counts = sizes - span + 1
        seg = np.repeat(np.arange(len(rows)), counts)
        starts = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts) + base[seg]
        order, common = suffix_order(data, starts, span)
        earlier, later = longest_matches(order, common, span)
        hit = earlier >= span
        if not keep_first:
            hit |= later >= span
            hit &= np.array([r[5] for r in rows])[seg]
        return [(rows[s][0], rows[s][1], rows[s][3] + f, rows[s][3] + e + span) for s, f, e in zip(*_stretches(hit, seg, starts - base[seg]), strict=True)]

    def run(batches):
        group, size, current = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in (batch.column(n) for n in ("doc_id", "h", "g", "start", "shape", "single", "bytes"))), strict=True):
                if row[2] != current and size > POOL:
                    yield _ranges(solve(group))
                    group, size = [], 0
                current = row[2]
                group.append(row)
                size += len(row[6])
        if group:
            yield _ranges(solve(group))

    return run


def _stretches(hit: np.ndarray, seg: np.ndarray, start: np.ndarray):
    """Segment, first and last start of each run of hits within a segment."""
    first = hit & np.concatenate(([True], ~hit[:-1] | (seg[1:] != seg[:-1])))
    last = hit & np.concatenate((~hit[1:] | (seg[1:] != seg[:-1]), [True]))
    return seg[first].tolist(), start[first].tolist(), start[last].tolist()


def _ranges(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "h", "first", "end"])


def _halves(span: int):
    """Divide segments (lo..hi: offsets of their starts before the anchor) at the middle of their dyadic block.

    full is the hash of a half's bytes, core that of the bytes which all strings of its block have.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, h, g, start, lo, hi, level, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "h", "g", "start", "lo", "hi", "level", "bytes")), strict=True):
                size = 1 << level >> 1
                base = hi >> level << level
                for block in (base, base + size):  # larger offsets start earlier
                    a, b = max(lo, block), min(hi, block + size - 1)
                    if a > b:
                        continue
                    part = text[hi - b : hi - a + span]
                    core = text[hi - block : hi - block - size + 1 + span] if block <= hi else b""
                    digest = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in (part, core)]
                    rows.append((doc, h, g, start + hi - b, a, b, level - 1, block, part, *digest))
            cols = list(zip(*rows, strict=True)) or [()] * 11
            types = [pa.int64()] * 8 + [pa.binary()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "h", "g", "start", "lo", "hi", "level", "block", "bytes", "full", "core"])

    return run


def _refined(large: DataFrame, keep_first: bool, span: int) -> DataFrame | None:
    """Removed ranges of anchors with many distinct segments, by counting equal halves."""
    out = None
    rows = large.select(*KEY, "g", "start", (F.expr("shiftright(shape, 8)") - F.expr("shape & 255")).alias("lo"), F.expr("shiftright(shape, 8)").alias("hi"), "bytes").withColumn("level", F.lit(8).cast("long"))
    for _ in range(8):
        half = materialize(rows.mapInArrow(_halves(span), "doc_id long, h long, g long, start long, lo long, hi long, level long, block long, bytes binary, full long, core long"))
        same, cores = ["g", "lo", "hi", "full"], ["g", "block", "core"]
        counted = half.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "start")).alias("least"))
        shared = half.groupBy(*cores).agg(F.count("*").alias("m")).filter("m > 1").select(*cores)
        half = materialize(half.join(counted, same))
        whole = half.filter("n > 1")
        if keep_first:
            whole = whole.filter("not (struct(doc_id, h, start) <=> least)")
        ranges = whole.select(*KEY, F.col("start").alias("first"), (F.col("start") + F.col("hi") - F.col("lo") + span).alias("end"))
        out = ranges if out is None else out.unionByName(ranges)
        # one of each kind goes on: what occurs once may share parts with others, and those with what occurs twice
        rows = materialize(half.filter("struct(doc_id, h, start) <=> least").drop("n", "least").join(shared, cores, "left_semi"))
        if rows.isEmpty():
            break
    return out


def repeated_ranges(docs: DataFrame, keep_first: bool = False, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, first, end): byte ranges of docs(doc_id long, h, text) covered by strings of span bytes that occur elsewhere too.

    keep_first: only strings that also start earlier, in order of (doc_id, h, position); ranges may overlap.
    """
    scan = docs.mapInArrow(_scan(span, gram), "doc_id long, h long, g long, seg long, left long, right long, start long, shape long")
    twice = docs.select("text").mapInArrow(_anchors(span, gram), "g long").groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    twice = materialize(twice)  # written, like the other aggregates here, so that AQE can split the rows of a hot anchor in the join
    found = materialize(scan.join(twice, "g"))
    drop(twice)
    same = ["g", "seg", "shape"]
    least = F.min(F.struct(*KEY, "start")) if keep_first else F.first(F.struct(*KEY, "start"))
    classes = materialize(found.groupBy(*same).agg(F.count("*").alias("n"), least.alias("one"), F.first("left").alias("left"), F.first("right").alias("right")))
    whole = found.join(classes.filter("n > 1").select(*same, "one"), same)
    if keep_first:
        whole = whole.filter("not (struct(doc_id, h, start) <=> one)")
    out = materialize(whole.select(*KEY, F.col("start").alias("first"), (F.col("start") + F.expr("shape & 255") + span).alias("end")))
    drop(found)

    for side in ("left", "right"):
        shared = classes.filter(F.col(side) != 0).groupBy("g", side).agg(F.count("*").alias("k")).filter("k > 1").select("g", side, F.lit(True).alias(f"{side}_shared"))
        classes = classes.join(materialize(shared), ["g", side], "left")
    some = materialize(classes.filter("left_shared or right_shared").select(*same, "n", "one"))
    groups = some.groupBy("g").agg(F.count("*").alias("d"), F.min("n").alias("least")).filter("d > 1" if keep_first else "d > 1 and least = 1")
    want = some.join(materialize(groups), "g").select("one.*", "g", "shape", (F.col("n") == 1).alias("single"), (F.col("d") > GROUP).alias("large"))
    want = materialize(want)
    if want.isEmpty():
        return out
    by_doc = want.groupBy(*KEY).agg(F.collect_list(F.struct("g", "start", "shape", "single", "large")).alias("want"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "i", "h": "j"})
    cut = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))).select(*KEY, "text", "want")
    cut = materialize(cut.mapInArrow(_cut(span), "doc_id long, h long, g long, start long, shape long, single boolean, large boolean, bytes binary"))
    small = cut.filter("not large").repartition("g").sortWithinPartitions("g")
    out = out.unionByName(small.mapInArrow(_pooled(keep_first, span), "doc_id long, h long, first long, end long"))
    large = cut.filter("large")
    if not large.isEmpty():
        out = out.unionByName(_refined(large, keep_first, span))
    return out


def _kept(batches):
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
            end = -1
            for r in sorted((r["first"], r["end"]) for r in ranges or ()):
                if r[0] > end:
                    kept.update(raw[at : r[0]])
                    spans += 1
                    removed += r[1] - r[0]
                elif r[1] > end:
                    removed += r[1] - end
                end = at = max(end, r[1])
            kept.update(raw[max(at, 0) :])
            rows.append((len(raw), removed, spans, kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_ranges(docs: DataFrame, keep_first: bool = False, span: int = SPAN) -> DataFrame:
    """docs(doc_id, text) with ranges, an array of (first, end) or null; null texts have none, repeated rows count as occurrences."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    ranges = repeated_ranges(docs, keep_first, span).groupBy(*KEY).agg(F.collect_set(F.struct("first", "end")).alias("ranges")).withColumnsRenamed({"doc_id": "i", "h": "j"})
    return docs.join(ranges, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")), "left").select("doc_id", "text", "ranges")


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract: every byte under a string of 200 bytes that also starts anywhere else is removed."""
    return with_ranges(table(spark, sf_dir, "documents")).mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
