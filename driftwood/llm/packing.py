"""Packing token sequences by cutting-stock column generation.

Each document is tokenised once and cut into full rows of LENGTH ids, which fill sequences of their own, a half row if
one is left, and a rest shorter than that.  Half rows and rests are the items of a cutting-stock problem, which only
sees the histogram of their lengths (LENGTH / 2 counts at any corpus size): a linear program over patterns of length
classes, GRID lengths wide, whose columns are priced by a knapsack dynamic program.  Patterns are rounded down and
filled with the lengths of their classes; the remaining items fill one sequence after another by subset sums.  Documents are
ranked within their length by a two-level count (bucket offsets plus rank in bucket), and a rank names its pattern,
sequence and offset, so no group of equal lengths meets in one task.

Ids are those of the tokenizers file: tiktoken with the same vocabulary makes them several times faster and gives the same ids for
texts of plain Latin characters; any other text, and one with the special token's string, goes through tokenizers.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import materialize, table, tune

LENGTH = 1024
#: Hash buckets of the two-level ranking.
BUCKETS = 512
#: Lengths of one class of the linear program; an item wastes GRID - 1 ids of its slot at most.
GRID = 4
#: Column generation stops when no pattern improves the program by more than this share, or after so many rounds.
GAP, ROUNDS = 2e-4, 4000
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ſ]*")


def solve(demand: np.ndarray, length: int = LENGTH, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Fractional patterns (counts by item length, times used) that cover demand[item length]."""
    sizes = np.flatnonzero(demand)
    m = len(sizes)
    if not m:
        return []
    columns = np.diag((length // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    times = inverse @ demand[sizes]
    for _ in range(rounds):
        price = np.ones(m) @ inverse
        column, value = knapsack(sizes, price, length)
        if value <= 1 + gap:
            break
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-12, times / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        move = ratio[out]
        times -= move * step
        times[out] = move
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = column
    patterns = []
    for j in range(m):
        if times[j] > 1e-9:
            full = np.zeros(length + 1, np.int64)
            full[sizes] = columns[:, j].round().astype(np.int64)
            patterns.append((full, float(times[j])))
    return patterns


def knapsack(sizes: np.ndarray, price: np.ndarray, length: int) -> tuple[np.ndarray, float]:
    """The pattern of largest price with a total size of at most length (dynamic program over capacities)."""
    best, took = np.zeros(length + 1), np.full(length + 1, -1)
    upto = np.searchsorted(sizes, np.arange(length + 1), "right")
    for c in range(1, length + 1):
        best[c], n = best[c - 1], upto[c]
        if n:
            value = best[c - sizes[:n]] + price[:n]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-15:
                best[c], took[c] = value[k], k
    column, c = np.zeros(len(sizes)), length
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            column[took[c]] += 1
            c -= int(sizes[took[c]])
    return column, float(best[length])


def fill(left: np.ndarray, length: int) -> np.ndarray:
    """A pattern with the longest item left and the items that fill its sequence best (subset sums as bits)."""
    pattern = np.zeros_like(left)
    longest = int(np.flatnonzero(left)[-1])
    pattern[longest] = 1
    room = length - longest
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in np.flatnonzero(left[: room + 1])[::-1].tolist():
        for _ in range(min(int(left[size]) - (size == longest), room // size)):
            new = (reach | reach << size) & limit
            if new != reach:
                steps.append((size, reach))
                reach = new
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for size, before in reversed(steps):
        if not before >> at & 1:
            pattern[size] += 1
            at -= size
    return pattern


def exact(classes: np.ndarray, times: int, left: np.ndarray, grid: int) -> list[tuple[np.ndarray, int]]:
    """The class pattern used times times, as patterns of the lengths left in its classes; takes them from left."""
    slots = np.repeat(np.arange(len(classes)), classes)
    runs = []
    for c in slots.tolist():  # each slot takes the next times items of its class, in order of length
        run, need = [], times
        for size in range(grid * c, grid * (c - 1), -1):
            n = min(need, int(left[size])) if size < len(left) else 0
            if n:
                run.append((size, n))
                left[size] -= n
                need -= n
        runs.append(run)
    out, at = [], [[i, run[0][1]] for i, run in zip([0] * len(runs), runs, strict=True)]
    done = 0
    while done < times:
        n = min(x[1] for x in at)
        pattern = np.zeros_like(left)
        for x, run in zip(at, runs, strict=True):
            pattern[run[x[0]][0]] += 1
            x[1] -= n
            if not x[1] and x[0] + 1 < len(run):
                x[0] += 1
                x[1] = run[x[0]][1]
        out.append((pattern, n))
        done += n
    return out


def plan(demand: np.ndarray, length: int = LENGTH, grid: int = GRID) -> tuple[list[tuple[np.ndarray, int]], int]:
    """Whole patterns (counts by item length, times used) that use exactly demand, and the number of sequences."""
    left = demand.astype(np.int64).copy()
    by_class = np.zeros(length // grid + 1)
    np.add.at(by_class, -(-np.arange(len(left)) // grid), left)
    out: list[tuple[np.ndarray, int]] = []
    for pattern, times in solve(by_class, length // grid):
        n = int(times + 1e-9)
        used = pattern > 0
        n = min(n, int((by_class[used] // pattern[used]).min()))
        if n:
            by_class -= pattern * n
            out += exact(pattern, n, left, grid)
    while left.any():
        pattern = fill(left, length)
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        out.append((pattern, n))
        left -= pattern * n
    return out, sum(n for _, n in out)


class Places:
    """From (item length, rank) to (sequence, offset)."""

    def __init__(self, patterns: list[tuple[np.ndarray, int]]):
        rows, given, sequence = [], {}, 0
        for pattern, times in patterns:
            offset = 0
            for size in np.flatnonzero(pattern).tolist():
                each = int(pattern[size])
                first = given.get(size, 0)
                rows.append((size, first, each, sequence, offset))
                given[size] = first + each * times
                offset += size * each
            sequence += times
        rows.sort()
        self.size, self.first, self.each, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.key = self.size << 44 | self.first

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, size << 44 | rank, "right") - 1
        at = rank - self.first[k]
        return self.sequence[k] + at // self.each[k], self.offset[k] + at % self.each[k] * size


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> numpy ids, as the tokenizers file at path gives them without special tokens added."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    fast = None
    ranks = re.sub(r"\.json$", ".tiktoken", path)
    if ranks != path:
        import public_tokenizers

        with open(ranks, "rb") as f:
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast and "<|" not in text and PLAIN.fullmatch(text):
            return np.array(fast.encode_ordinary(text), "<u4")
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def _pieces(path: str, length: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            tokens, crcs = [], []
            for text in batch.column("text"):
                ids = np.append(encode(text.as_py() or ""), np.zeros(1, "<u4")).astype("<u4")
                tokens.append(len(ids))
                cuts = [*range(0, len(ids), length), len(ids)]
                if length // 2 < cuts[-1] - cuts[-2] < length:
                    cuts.insert(-1, cuts[-2] + length // 2)
                crcs.append([zlib.crc32(ids[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    return run


def _placed(places, rests: int, length: int):
    """rests: sequences that hold rests and half rows; those of full rows follow."""

    def run(batches):
        own = places.value
        for b in batches:
            total, rank, half_rank, full_rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_tokens", "rank", "half_rank", "full_rank"))
            full, half, rest = parts(total, length)
            n = full + half + (rest > 0)
            doc = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            is_half = (half[doc] == 1) & (k == full[doc])
            is_rest = (k >= full[doc]) & ~is_half
            size = np.where(is_half, length // 2, np.where(is_rest, rest[doc], length))
            sequence, offset = rests + full_rank[doc] + k, np.zeros(len(doc), np.int64)
            for some, ranks in ((is_half, half_rank), (is_rest, rank)):
                if some.any():
                    sequence[some], offset[some] = own(size[some], ranks[doc][some])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(k * length - is_rest * half[doc] * (length // 2)), pa.array(size), b.column("crcs").flatten(), pa.array(total[doc]), pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def parts(total, length: int):
    """Full rows, half rows (0 or 1) and the rest of so many ids; a rest may be as long as a half row."""
    rest = total % length
    half = (rest > length // 2) * 1
    return total // length, half, rest - half * (length // 2)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of each row of docs(doc_id, text).

    A document's ids are those of its text (null: empty) and a closing id 0.  Repeated rows are packed as often as they
    occur; rows with a null doc_id are packed too; an empty table gives no row.
    """
    spark = docs.sparkSession
    tune(spark)
    tokens = materialize(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, length), "doc_id long, doc_tokens long, crcs array<long>"))
    rest = F.col("doc_tokens") % length
    half = (rest > length // 2).cast("long")
    tokens = tokens.withColumns({
        "full": F.floor(F.col("doc_tokens") / length),
        "half": half,
        "rest": rest - half * (length // 2),
        "bucket": F.pmod(F.xxhash64("doc_id", "doc_tokens", F.element_at("crcs", 1)), F.lit(buckets)).cast("int"),
    })
    counts = materialize(tokens.groupBy("bucket", "rest").agg(F.count("*").alias("n"), F.sum("half").alias("half"), F.sum("full").alias("full")))
    demand = np.zeros(length // 2 + 1, np.int64)
    for row in counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("half").alias("half")).collect():  # one row for each length
        demand[row.rest] += row.n
        demand[length // 2] += row.half
    demand[0] = 0
    patterns, rests = plan(demand, length)

    # ranks among items of one length: half rows come before rests of that length
    until = lambda *by: Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rank_base = counts.select("bucket", "rest", F.coalesce(F.sum("n").over(until("rest")), F.lit(0)).alias("rank_base"))
    by_bucket = counts.groupBy("bucket").agg(F.sum("full").alias("full"), F.sum("half").alias("half"))  # one row for each bucket
    bases = by_bucket.select("bucket", *(F.coalesce(F.sum(c).over(until()), F.lit(0)).alias(f"{c}_base") for c in ("full", "half")))
    halves = F.lit(int(counts.agg(F.sum("half")).first()[0] or 0))

    order = ["doc_id", "doc_tokens", "crcs"]
    so_far = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        tokens.repartition("bucket")
        .withColumns({"rank": F.row_number().over(Window.partitionBy("bucket", "rest").orderBy(*order)) - 1, "full_rank": F.sum("full").over(so_far) - F.col("full"), "half_rank": F.sum("half").over(so_far) - F.col("half")})
        .join(rank_base, ["bucket", "rest"])
        .join(bases, "bucket")
        .select(
            "doc_id",
            "doc_tokens",
            "crcs",
            (F.col("rank") + F.col("rank_base") + F.when(F.col("rest") == length // 2, halves).otherwise(0)).alias("rank"),
            (F.col("full_rank") + F.col("full_base")).alias("full_rank"),
            (F.col("half_rank") + F.col("half_base")).alias("half_rank"),
        )
    )
    places = spark.sparkContext.broadcast(Places(patterns))
    return ranked.mapInArrow(_placed(places, rests, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_cutting_stock_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
