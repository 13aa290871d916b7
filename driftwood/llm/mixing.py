"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree: DataFrame functions only.

A source's documents lie end to end in the order of a hash and are cut into blocks of BLOCK words.  Its target says how many
blocks the mix takes of it (passes over all of them, then a part of a pass, whose last block is cut to hit the target).  The
tree deals these quotas out: a node's blocks go to its two halves by one multivariate-hypergeometric draw, which is what a
random permutation of all blocks would give, until a node is one output shard.  Quotas stay exact at every split.  A shard
then takes the next blocks of each source's permutation, so shards are disjoint, and shuffles them within itself.

Every random number is a hash, so reruns agree on any cluster.  Nothing is as long as a source: blocks come from the documents
that they begin in, places from range partitions, and a node's row has at most WIDTH sources; more sources are a tree of their own,
in which a group of WIDTH sources is dealt out as one before its members are.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import materialize, table
from driftwood.llm.ordering import numbered

#: Words of a block; blocks of an output shard; sources in one row.
BLOCK, SHARD_BLOCKS, WIDTH = 1024, 256, 256
#: Weights of the sources in their order, again from the first; words of the mix per word there is; most copies of a word.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources(g, size), g their number in order, with target: share of all words by weight, at most most times a source's size.

    What a source can't take is shared again by weight among the others.  A round of the loop is one sum over the sources.
    """
    weighed = materialize(sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("g") % len(weights) + 1).cast("int"))))
    words, free = weighed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    level, before = (share * words / free if free else 0.0), None
    while level != before:
        full = F.lit(level) * F.col("w") > most * F.col("size")
        capped, free = weighed.agg(F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0))).first()
        before = level
        if free:
            level = (share * words - most * capped) / free
    return weighed.withColumn("target", F.least(F.lit(level) * F.col("w"), F.lit(float(most)) * F.col("size"))).drop("w")


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ln_factorial(x: str) -> str:
    """By Stirling's series from 21 on, where its error is below a double's."""
    return _let("y", f"cast({x} as double)", "if(y < 21, ln(cast(factorial(cast(y as int)) as double)), (y + 0.5) * ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * pow(y, 5)))")


def hypergeometric(whole: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked ones among drawn of whole, at quantile u: inversion over all values within ten deviations of the mode."""
    spread = "sqrt(cast(p.n as double) * p.k / greatest(p.t, 1) * (1 - cast(p.k as double) / greatest(p.t, 1)) * (p.t - p.n) / greatest(p.t - 1, 1))"
    bounds = f"""named_struct('t', p.t, 'k', p.k, 'n', p.n, 'u', p.u, 'mode', p.mode,
        'lo', greatest(0L, p.n + p.k - p.t, p.mode - cast(10 * {spread} as bigint) - 20), 'hi', least(p.n, p.k, p.mode + cast(10 * {spread} as bigint) + 20))"""

    def log(k: str) -> str:
        return f"(0 - {_ln_factorial(k)} - {_ln_factorial(f'(b.k - {k})')} - {_ln_factorial(f'(b.n - {k})')} - {_ln_factorial(f'(b.t - b.k - b.n + {k})')})"

    ratio = "cast(b.k - i as double) * (b.n - i) / (cast(i + 1 as double) * greatest(b.t - b.k - b.n + i + 1, 1))"
    total = f"aggregate(sequence(b.lo, b.hi), named_struct('w', b.w, 'sum', 0D), (s, i) -> named_struct('w', s.w * {ratio}, 'sum', s.sum + s.w), s -> s.sum)"
    found = f"aggregate(sequence(b.lo, b.hi), named_struct('w', b.w, 'sum', 0D, 'x', b.lo), (s, i) -> named_struct('w', s.w * {ratio}, 'sum', s.sum + s.w, 'x', if(s.sum + s.w < b.cut, least(i + 1, b.hi), s.x)), s -> s.x)"
    weighed = f"named_struct('t', b.t, 'k', b.k, 'n', b.n, 'u', b.u, 'lo', b.lo, 'hi', b.hi, 'w', exp({log('b.lo')} - {log('b.mode')}))"
    drawn_ = f"named_struct('t', b.t, 'k', b.k, 'n', b.n, 'lo', b.lo, 'hi', b.hi, 'w', b.w, 'cut', b.u * {total})"
    mode = "greatest(0L, least(p.n, p.k, cast(floor((p.n + 1D) * (p.k + 1D) / (p.t + 2D)) as bigint)))"
    start = f"named_struct('t', {whole}, 'k', {marked}, 'n', {drawn}, 'u', {u})"
    with_mode = f"named_struct('t', p.t, 'k', p.k, 'n', p.n, 'u', p.u, 'mode', {mode})"
    return _let("p", start, _let("p", with_mode, _let("b", bounds, _let("b", weighed, _let("b", drawn_, found)))))


def _halves(nodes: DataFrame, level: int, seed: int) -> DataFrame:
    """nodes(family, node, slots, members) to their two halves; slots is how many blocks the left one takes."""
    u = f"(pmod(xxhash64({seed}L, {level}, family, node, m.m), 9007199254740992L) + 0.5D) / 9007199254740992D"
    x = hypergeometric("a.rest", "m.q", "a.n", u)
    step = _let("x", x, "named_struct('n', a.n - x, 'rest', a.rest - m.q, 'left', concat(a.left, array(x)))")
    start = "named_struct('n', slots, 'rest', aggregate(members, 0L, (a, m) -> a + m.q), 'left', cast(array() as array<bigint>))"
    drawn = nodes.withColumn("left", F.expr(f"aggregate(members, {start}, (a, m) -> {step}, a -> a.left)"))
    left = "filter(zip_with(members, left, (m, x) -> named_struct('m', m.m, 'q', x, 'start', m.start)), m -> m.q > 0)"
    right = "filter(zip_with(members, left, (m, x) -> named_struct('m', m.m, 'q', m.q - x, 'start', m.start + x)), m -> m.q > 0)"
    return drawn.select("family", F.expr(f"inline(array(named_struct('node', 2 * node, 'members', {left}), named_struct('node', 2 * node + 1, 'members', {right})))")).filter("size(members) > 0")


def split(quotas: DataFrame, depth: int, seed: int = 0, width: int = WIDTH) -> DataFrame:
    """quotas(g, q) to (shard, g, q, start): how many of a source's blocks each of 2^depth shards takes, and from which one on.

    Shards have equally many blocks, up to one.
    """
    sources, blocks = quotas.agg(F.coalesce(F.max("g"), F.lit(0)) + 1, F.coalesce(F.sum("q"), F.lit(0))).first()
    stage = max(0, ceil(log2(sources) / log2(width)) - 1)
    known, shards = None, 1 << depth
    for t in reversed(range(stage + 1)):
        members = quotas.groupBy(F.expr(f"g div {width**t}").alias("m")).agg(F.sum("q").alias("q"))
        nodes = members.groupBy(F.expr(f"m div {width}").alias("family")).agg(F.sort_array(F.collect_list(F.struct("m", "q", F.lit(0).cast("bigint").alias("start")))).alias("members"))
        nodes = nodes.select("family", F.lit(0).cast("bigint").alias("node"), "members")
        levels = []
        for level in range(depth):
            if known is None:  # blocks of the shards under the left half
                span = shards >> level
                a, middle = F.col("node") * span, F.col("node") * span + span // 2
                slots = F.floor(middle * F.lit(blocks).cast("decimal(20,0)") / shards) - F.floor(a * F.lit(blocks).cast("decimal(20,0)") / shards)
                nodes = nodes.withColumn("slots", slots.cast("bigint"))
            else:
                nodes = nodes.join(known.filter(f"level = {level + 1} and node % 2 = 0").select("family", F.expr("node div 2").alias("node"), "slots"), ["family", "node"], "left").withColumn("slots", F.coalesce("slots", F.lit(0).cast("bigint")))
            nodes = materialize(_halves(nodes, level, seed))
            levels.append(nodes.select(F.lit(level + 1).alias("level"), "node", F.inline("members")))
        if t:
            known = levels[0] if levels else None
            for more in levels[1:]:
                known = known.unionByName(more)
            known = known and known.select("level", "node", F.col("m").alias("family"), F.col("q").alias("slots"))
    return nodes.select(F.col("node").alias("shard"), F.inline("members")).withColumnRenamed("m", "g")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (g, doc, doc_id, source, size, source_size, target) and the mix as their pieces.

    (g, doc) is a row's source and place in it.  Pieces: (shard, place, pass, g, doc, start, words), words start ..
    start + words - 1 of a row, in the place of its block in its shard; a shard is read by place, then doc and start.  Null and
    wordless texts have no piece.  A null source is a source, the last.  Repeated rows are rows of their own; which of them
    a pass takes in part is the same to them.
    """
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order.alias("h"))
    placed = materialize(numbered(sized, ["source"], [F.col("h"), F.col("doc_id").asc_nulls_first()], "size"))
    sources = numbered(placed.groupBy("source").agg(F.max("total").alias("size")), [], [F.col("source").asc_nulls_last()])
    aims = materialize(targets(sources.select(F.col("source").alias("s"), F.col("place").alias("g"), "size"), weights, share, most).select("s", "g", "target"))
    rows = materialize(placed.join(aims, F.col("source").eqNullSafe(F.col("s"))).select("g", F.col("place").alias("doc"), "doc_id", "source", "size", F.col("total").alias("source_size"), "target", "before"))

    full, rest = "cast(floor(target / source_size) as bigint)", "cast(round(target - floor(target / source_size) * source_size) as bigint)"
    cut = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(before div {block}, (before + size - 1) div {block})")))
    cut = cut.withColumn("first", F.greatest("before", F.col("block") * block)).withColumn("end", F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * block))
    blocks = cut.filter(f"first = block * {block}").select("g", "block", F.expr(f"least({block}L, source_size - block * {block})").alias("words"), F.expr(full).alias("full"), F.expr(rest).alias("rest"), F.expr(f"(source_size + {block} - 1) div {block}").alias("blocks"))
    shuffled = numbered(blocks, ["g"], [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("g"), F.col("block"))), F.col("block")], "words")
    passes = shuffled.withColumn("pass", F.explode(F.expr("sequence(0L, full)"))).withColumn("words", F.expr("if(pass < full, words, least(words, rest - before))")).filter("words > 0")
    units = materialize(passes.select("g", "block", "pass", "words", (F.col("pass") * F.col("blocks") + F.col("place")).alias("at")))

    quotas = materialize(units.groupBy("g").agg(F.count("*").alias("q")))
    many = quotas.agg(F.coalesce(F.sum("q"), F.lit(0))).first()[0]
    leaves = split(quotas, max(0, ceil(log2(max(many, 1) / shard_blocks))), seed)
    dealt = leaves.select("shard", "g", F.explode(F.expr("sequence(start, start + q - 1)")).alias("at"))
    units = units.join(dealt, ["g", "at"])
    in_shard = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "g", "at"), "g", "at")
    units = units.withColumn("place", F.row_number().over(in_shard) - 1).withColumnRenamed("words", "taken")
    pieces = cut.select("g", "doc", "block", (F.col("first") - F.col("block") * block).alias("at_block"), (F.col("first") - F.col("before")).alias("start"), (F.col("end") - F.col("first")).alias("length"))
    pieces = pieces.join(units.select("g", "block", "shard", "place", "pass", "taken"), ["g", "block"]).withColumn("words", F.least("length", F.col("taken") - F.col("at_block"))).filter("words > 0")
    return rows.drop("before"), pieces.select("shard", "place", "pass", "g", "doc", "start", "words")


def op11_source_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    rows, pieces = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("g", "doc").agg(F.sum("words").alias("taken"))
    return rows.join(taken, ["g", "doc"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


#: The same words by closed forms and one pass over each source; shards don't matter to a document's sum.
OP11_SQL = rf"""
WITH sized AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))) AS h FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS g FROM sized GROUP BY source),
weighed AS (SELECT *, {list(WEIGHTS)}[g % {len(WEIGHTS)} + 1] AS w FROM sources),
levels AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - {MOST} * (sum(source_size) OVER o - source_size)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
           FROM weighed WINDOW o AS (ORDER BY {MOST}::DOUBLE * source_size / w, g ROWS UNBOUNDED PRECEDING)),
chosen AS (SELECT min_by(level, ({MOST}::DOUBLE * source_size / w, g)) AS level FROM levels WHERE level * w <= {MOST} * source_size),
aims AS (SELECT source, g, source_size, least(c.level * w, {MOST}::DOUBLE * source_size) AS target FROM weighed, chosen c),
placed AS (SELECT d.*, g, source_size, target, row_number() OVER () AS k, (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS w0
           FROM sized d JOIN aims a ON a.source IS NOT DISTINCT FROM d.source),
cut AS (SELECT k, g, block, source_size, target, greatest(w0, block * {BLOCK}) - block * {BLOCK} AS f, least(w0 + size, (block + 1) * {BLOCK}) - block * {BLOCK} AS e
        FROM (SELECT *, unnest(range(w0 // {BLOCK}, (w0 + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0)),
blocks AS (SELECT DISTINCT g, block, least({BLOCK}, source_size - block * {BLOCK}) AS words, floor(target / source_size)::BIGINT AS passes, round(target - floor(target / source_size) * source_size)::BIGINT AS rest FROM cut),
part AS (SELECT *, greatest(0, least(words, rest - (sum(words) OVER (PARTITION BY g ORDER BY md5(concat_ws(':', '0', g, block)), block ROWS UNBOUNDED PRECEDING) - words))) AS upto FROM blocks),
taken AS (SELECT k, sum(passes * (e - f) + greatest(0, least(e, upto) - f))::BIGINT AS taken FROM cut JOIN part USING (g, block) GROUP BY k)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (k)
"""
