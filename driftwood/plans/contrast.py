"""Contrastive losses with same-group and shifted negatives, discriminator scores, attention and memory over the vectors.

Batches are 32 rows in the order of ids; rows 2k and 2k + 1 are the two views of one item.  All rows of the table take part.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwood.functions import scalars as fn
from driftwood.operators import ranking
from driftwood.plans.detection import vectors
from driftwood.plans.registry import query
from driftwood.sources.tables import table

TAU, MARGIN, WEIGHT, DIM, DRAWS, ROUNDS, MEMORY = 0.5, 0.5, 0.5, 64, 4, 3, 8
EPS = 1e-12

U = "(('0x' || substr(sha256({}), 1, 15))::BIGINT / 1152921504606846976.0)"
UNIT = "list_transform({0}, lambda a: a / greatest(sqrt(list_dot_product({0}, {0})), 1e-12))"
ROWS = f"""v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings WHERE len(embedding) = {DIM}),
k AS (SELECT *, k // 2 AS pair, k // 32 AS batch FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k FROM v)),
s AS (SELECT *, max(CASE WHEN k % 2 = 0 THEN label END) OVER (PARTITION BY pair) % 2 AS grp, list_transform(x, lambda a, i: CASE WHEN (i - 1) % 8 = id % 8 THEN 0.0 ELSE a END) AS xs FROM k),
b AS (SELECT id, k, pair, batch, grp, x, xs, {UNIT.format("x")} AS z, {UNIT.format("xs")} AS zs FROM s)"""


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)


def unit(x):
    """x over its length, as it is where that is next to nothing."""
    norm = F.greatest(F.sqrt(dot(x, x)), F.lit(EPS))
    return F.transform(x, lambda a: a / norm)


def distance(a, b):
    return F.sqrt(fn.squared_distance(a, b))


def whole(spark, d):
    return vectors(spark, d).filter(F.size("x") == DIM)


def batches(rows):
    """rows(id, x, label) with k, pair, batch, the pair's group, the shifted copy xs and both at length 1 (z, zs).

    The shifted copy has every eighth feature, from the row's own on, at the common value 0.
    """
    k = ranking.running_totals(rows.select("id", "x", "label"), "id", {"_n": F.lit(1)}).withColumn("k", F.col("_n") - 1)
    k = k.withColumns({"pair": F.floor(F.col("k") / 2), "batch": F.floor(F.col("k") / 32)})
    first = F.max(F.when(F.col("k") % 2 == 0, F.col("label"))).over(Window.partitionBy("pair"))  # two rows
    xs = F.transform("x", lambda a, i: F.when(i % 8 == F.col("id") % 8, 0.0).otherwise(a))
    return k.select("id", "k", "pair", "batch", (first % 2).alias("grp"), "x", xs.alias("xs")).withColumns({"z": unit(F.col("x")), "zs": unit(F.col("xs"))})


def _other(b, *columns):
    return b.select("batch", *(F.col(c).alias(f"{c}_") for c in columns))


@query(f"""WITH {ROWS}, p AS (SELECT a.batch, a.k, any_value(list_dot_product(a.z, a.zs)) AS sh, max(list_dot_product(a.z, c.z)) FILTER (WHERE c.pair = a.pair) AS pos, sum(exp(list_dot_product(a.z, c.z) / {TAU})) AS total
  FROM b a JOIN b c ON a.batch = c.batch AND a.k <> c.k AND a.grp = c.grp GROUP BY 1, 2),
l AS (SELECT batch, ln(total + {WEIGHT} * exp(sh / {TAU})) - pos / {TAU} AS l FROM p)
SELECT batch, count(l) AS anchors, round(avg(l), 6) AS loss FROM l GROUP BY 1""")
def loss_infonce_same_group(spark, d):
    """InfoNCE of each batch whose negatives are the rows of the anchor's group and its own shifted copy, at half weight."""
    b = batches(whole(spark, d))
    pairs = b.join(_other(b, "k", "pair", "grp", "z"), "batch").filter("k <> k_ and grp = grp_")  # 31 partners a row
    s = dot(F.col("z"), F.col("z_"))
    p = pairs.groupBy("batch", "k").agg(F.first(dot(F.col("z"), F.col("zs"))).alias("sh"), F.max(F.when(F.col("pair") == F.col("pair_"), s)).alias("pos"), F.sum(F.exp(s / TAU)).alias("total"))
    loss = F.log(F.col("total") + WEIGHT * F.exp(F.col("sh") / TAU)) - F.col("pos") / TAU
    return p.select("batch", loss.alias("l")).groupBy("batch").agg(F.count("l").alias("anchors"), F.round(F.avg("l"), 6).alias("loss"))


@query(f"""WITH {ROWS}, d AS (SELECT a.batch, a.pair, any_value(list_distance(a.z, a.zs)) AS sh, max(list_distance(a.z, c.z)) FILTER (WHERE c.pair = a.pair) AS pos,
  min(list_distance(a.z, c.z)) FILTER (WHERE c.pair <> a.pair AND c.grp = a.grp) AS own, min(list_distance(a.z, c.z)) FILTER (WHERE c.pair <> a.pair) AS other
  FROM b a JOIN b c ON a.batch = c.batch WHERE a.k % 2 = 0 AND c.k % 2 = 1 GROUP BY 1, 2)
SELECT batch, count(pos) AS anchors, round(avg(greatest(0, pos - coalesce(own, other) + {MARGIN})) + {WEIGHT} * avg(greatest(0, pos - sh + {MARGIN})), 6) AS loss FROM d WHERE pos IS NOT NULL AND other IS NOT NULL GROUP BY 1""")
def loss_triplet_same_group(spark, d):
    """Triplet loss of each batch against the hardest negative of the anchor's group (any group's where it is alone), and a second hinge for its shifted copy."""
    b = batches(whole(spark, d))
    pairs = b.filter("k % 2 = 0").join(_other(b.filter("k % 2 = 1"), "pair", "grp", "z"), "batch")  # 16 partners a row
    far, away = distance(F.col("z"), F.col("z_")), F.col("pair") != F.col("pair_")
    p = pairs.groupBy("batch", "pair").agg(
        F.first(distance(F.col("z"), F.col("zs"))).alias("sh"), F.max(F.when(~away, far)).alias("pos"),
        F.min(F.when(away & (F.col("grp") == F.col("grp_")), far)).alias("own"), F.min(F.when(away, far)).alias("other"),
    ).filter("pos is not null and other is not null")
    hinge = lambda n: F.avg(F.greatest(F.lit(0.0), F.col("pos") - n + MARGIN))
    return p.groupBy("batch").agg(F.count("pos").alias("anchors"), F.round(hinge(F.coalesce("own", "other")) + WEIGHT * hinge(F.col("sh")), 6).alias("loss"))


def mean_vector(rows, keys, name, x="x"):
    """(keys, name): the mean vector of each group, one row for each position in between."""
    by = [F.col(k) for k in keys]
    m = rows.select(*by, F.posexplode(x).alias("i", "a")).groupBy(*by, "i").agg(F.avg("a").alias("m"))
    return m.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(name))


def sigmoid(v):
    return F.transform(v, lambda a: 1 / (1 + F.exp(-a)))


MEANS = "(SELECT {0}, list(m ORDER BY i) AS {2} FROM (SELECT {0}, i, avg(x[i]) AS m FROM (SELECT *, unnest(range(1, 65)) AS i FROM {1}) GROUP BY ALL) GROUP BY ALL)"
SIGMOID = "list_transform({}, lambda a: 1 / (1 + exp(-a)))"


@query(f"""WITH {ROWS}, g AS {MEANS.format("batch, grp", "b", "m")}, l AS (SELECT batch, list_dot_product(x, {SIGMOID.format("m")}) AS pos, list_dot_product(xs, {SIGMOID.format("m")}) AS neg FROM b JOIN g USING (batch, grp))
SELECT batch, round((avg(ln(1 + exp(-pos))) + avg(ln(1 + exp(neg)))) / 2, 6) AS loss FROM l GROUP BY 1""")
def loss_dgi_groups(spark, d):
    """Binary cross-entropy of a discriminator (a plain product) that tells rows from their shifted copies by the summary of their group in the batch."""
    b = batches(whole(spark, d))
    rows = b.join(mean_vector(b, ["batch", "grp"], "m"), ["batch", "grp"]).withColumn("s", sigmoid("m"))
    rows = rows.select("batch", dot(F.col("x"), F.col("s")).alias("pos"), dot(F.col("xs"), F.col("s")).alias("neg"))
    return rows.groupBy("batch").agg(F.round((F.avg(F.log(1 + F.exp(-F.col("pos")))) + F.avg(F.log(1 + F.exp("neg")))) / 2, 6).alias("loss"))


FIT = f"v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings WHERE len(embedding) = {DIM}), f AS (SELECT * FROM v WHERE id % 5 <> 0)"


@query(f"WITH {FIT}, g AS {MEANS.format('label', 'f', 'm')}, a AS {MEANS.format('1 AS one', 'f', 'w')} SELECT id, round(-list_dot_product(x, {SIGMOID.format('coalesce(m, w)')}), 6) AS score FROM v LEFT JOIN g USING (label), a")
def score_dgi(spark, d):
    """Disagreement with the summary of the training rows of a row's group, or with that of all where its group has none."""
    v = whole(spark, d)
    fit = v.filter("id % 5 <> 0")
    rows = v.join(mean_vector(fit, ["label"], "m"), "label", "left").crossJoin(F.broadcast(mean_vector(fit, [], "w")))  # one row
    return rows.select("id", F.round(-dot(F.col("x"), sigmoid(F.coalesce("m", "w"))), 6).alias("score"))


@query(f"""WITH {ROWS}, g AS (SELECT *, row_number() OVER w - 1 AS spot, count(*) OVER (PARTITION BY batch, grp) AS n, row_number() OVER (PARTITION BY batch ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY batch) AS size FROM b WINDOW w AS (PARTITION BY batch, grp ORDER BY k)),
t AS (SELECT *, CASE WHEN n > 1 THEN (spot + 1 + floor({U.format("'sgp:' || batch || ':' || grp")} * (n - 1))::BIGINT) % n END AS own, (pos + 1) % size AS next FROM g)
SELECT t.id, o.id AS partner FROM t JOIN g o ON t.batch = o.batch AND CASE WHEN t.own IS NULL THEN o.pos = t.next ELSE o.grp = t.grp AND o.spot = t.own END""")
def sampler_same_group(spark, d):
    """A partner of the same group in each row's batch: the group is turned by one drawn step; a row alone in its group has the next of its batch."""
    b = batches(whole(spark, d)).select("id", "k", "batch", "grp")
    by, all_ = Window.partitionBy("batch", "grp"), Window.partitionBy("batch")  # 32 rows
    g = b.withColumns({"at": F.row_number().over(by.orderBy("k")) - 1, "n": F.count("*").over(by), "pos": F.row_number().over(all_.orderBy("k")) - 1, "size": F.count("*").over(all_)})
    u = fn.u01(F.concat_ws(":", F.lit("sgp"), F.col("batch").cast("string"), F.col("grp").cast("string")))
    t = g.withColumn("own", F.when(F.col("n") > 1, (F.col("at") + 1 + F.floor(u * (F.col("n") - 1))) % F.col("n"))).withColumn("next", (F.col("pos") + 1) % F.col("size"))
    pairs = t.join(g.select("batch", F.col("grp").alias("grp_"), F.col("at").alias("at_"), F.col("pos").alias("pos_"), F.col("id").alias("partner")), "batch")
    return pairs.filter("case when own is null then pos_ = next else grp_ = grp and at_ = own end").select("id", "partner")


@query("""WITH s AS (SELECT o_orderkey AS a, (SELECT max(o_orderkey) FROM orders) AS top FROM orders), d AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), n AS (SELECT o, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT a, (a * 7 + i * 13) % top + 1 AS u FROM s, range(4) t(i)), m AS (SELECT DISTINCT a, u FROM c WHERE a <> u AND u IN (SELECT a FROM s)), i AS (SELECT a, u, count(*) AS common FROM m JOIN d x ON x.o = a JOIN d y ON y.o = u AND y.p = x.p GROUP BY 1, 2)
SELECT a AS anchor, u AS negative, round(1 - coalesce(common / (na.n + nu.n - common), 0), 6) AS distance FROM m LEFT JOIN i USING (a, u) LEFT JOIN n na ON na.o = a LEFT JOIN n nu ON nu.o = u""")
def dependency_distance(spark, d):
    """1 - Jaccard of the part sets of each order and of up to four sampled negatives; 1 where a set is empty."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("a"))
    top = orders.agg(F.max("a").alias("top"))
    deps = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("o"), F.col("l_partkey").alias("p")).distinct()
    c = orders.crossJoin(F.broadcast(top)).select("a", F.explode(F.array(*((F.col("a") * 7 + i * 13) % F.col("top") + 1 for i in range(4)))).alias("u"))
    m = c.distinct().filter("a <> u").join(orders.select(F.col("a").alias("u")), "u", "left_semi")
    size = deps.groupBy("o").agg(F.count("*").alias("n"))
    common = m.join(deps.select(F.col("o").alias("a"), "p"), "a").join(deps.select(F.col("o").alias("u"), "p"), ["u", "p"]).groupBy("a", "u").agg(F.count("*").alias("common"))
    rows = m.join(common, ["a", "u"], "left").join(size.select(F.col("o").alias("a"), F.col("n").alias("na")), "a", "left").join(size.select(F.col("o").alias("u"), F.col("n").alias("nu")), "u", "left")
    share = F.col("common") / (F.col("na") + F.col("nu") - F.col("common"))
    return rows.select(F.col("a").alias("anchor"), F.col("u").alias("negative"), F.round(1 - F.coalesce(share, F.lit(0.0)), 6).alias("distance"))


@query(f"""WITH {FIT}, m AS (SELECT id AS mid, x AS y FROM f ORDER BY {U.format("'mem:' || id")}, id LIMIT {MEMORY}),
s AS (SELECT id, mid, y, exp(list_dot_product(x, y) / 8.0) AS e FROM v, m WHERE id <> mid), w AS (SELECT id, mid, y, e / sum(e) OVER (PARTITION BY id) AS w FROM s)
SELECT id, count(*) AS seen, round(max(w), 6) AS top_weight, round(sum(w * y[1]), 6) AS first_feature FROM w GROUP BY 1""")
def encoder_gps_memory(spark, d):
    """Attention of every row over a memory of randomly drawn training rows, itself left out."""
    v = whole(spark, d).select("id", "x")
    memory = v.filter("id % 5 <> 0").withColumn("u", fn.u01(F.concat(F.lit("mem:"), F.col("id").cast("string")))).orderBy("u", "id").limit(MEMORY)
    s = v.crossJoin(F.broadcast(memory.select(F.col("id").alias("mid"), F.col("x").alias("y")))).filter("id <> mid")  # MEMORY rows
    e = F.exp(dot(F.col("x"), F.col("y")) / 8.0)
    return s.select("id", F.col("y")[0].alias("y"), e.alias("e")).groupBy("id").agg(
        F.count("*").alias("seen"), F.round(F.max("e") / F.sum("e"), 6).alias("top_weight"), F.round(F.sum(F.col("e") * F.col("y")) / F.sum("e"), 6).alias("first_feature"))


# a drawn neighbour is the training row at a drawn place of the label's training rows
NEAR = FIT + f""", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS spot, count(*) OVER (PARTITION BY label) AS n FROM f), c AS (SELECT label, max(n) AS n FROM r GROUP BY 1),
e AS (SELECT v.id, v.label, v.x, t.round, s.slot, floor({U.format("'near:' || v.id || ':' || t.round || ':' || s.slot")} * c.n)::BIGINT AS spot FROM v JOIN c USING (label), range({ROUNDS}) t(round), range({DRAWS}) s(slot)),
nb AS (SELECT e.id, e.label, e.round, e.slot, e.x, r.id AS other, r.x AS y FROM e JOIN r USING (label, spot))"""


def drawn(v):
    """(id, round, slot, x, other, y): DRAWS training rows of a row's label in each of ROUNDS rounds, drawn with replacement."""
    fit = v.filter("id % 5 <> 0")
    size = fit.groupBy("label").agg(F.count("*").alias("n"))
    at = ranking.running_totals(fit, "id", {"_n": F.lit(1)}, ["label"]).select("label", (F.col("_n") - 1).alias("at"), F.col("id").alias("other"), F.col("x").alias("y"))
    e = v.join(size, "label").select("id", "label", "x", "n", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("round")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    u = fn.u01(F.concat_ws(":", F.lit("near"), *(F.col(c).cast("string") for c in ("id", "round", "slot"))))
    return e.withColumn("at", F.floor(u * F.col("n"))).join(at, ["label", "at"]).select("id", "round", "slot", "x", "other", "y")


@query(f"""WITH {NEAR}, l AS (SELECT *, list_dot_product(x, y) / 8.0 AS dp, (list_sum(x) + list_sum(y)) / 64.0 AS gt FROM nb WHERE round = 0),
w AS (SELECT id, x, y, exp(dp) / sum(exp(dp)) OVER (PARTITION BY id) AS dw, exp(CASE WHEN gt > 0 THEN gt ELSE 0.2 * gt END) / sum(exp(CASE WHEN gt > 0 THEN gt ELSE 0.2 * gt END)) OVER (PARTITION BY id) AS gw FROM l)
SELECT id, round(sum(dw * y[1]), 6) AS dot_first, round(max(dw), 6) AS dot_top, round(sum(gw * y[1]), 6) AS gat_first, round(max(gw), 6) AS gat_top FROM w GROUP BY 1""")
def encoder_attention(spark, d):
    """Dot-product and additive (leaky) attention of every row over its drawn neighbours, with plain weights."""
    nb = drawn(whole(spark, d)).filter("round = 0")
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda acc, a: acc + a)
    gt = (total("x") + total("y")) / 64.0
    w = nb.select("id", F.col("y")[0].alias("y"), F.exp(dot(F.col("x"), F.col("y")) / 8.0).alias("d"), F.exp(F.when(gt > 0, gt).otherwise(0.2 * gt)).alias("g"))
    out = [f(c, n) for n, c in (("dot", "d"), ("gat", "g")) for f in (
        lambda c, n: F.round(F.sum(F.col(c) * F.col("y")) / F.sum(c), 6).alias(f"{n}_first"), lambda c, n: F.round(F.max(c) / F.sum(c), 6).alias(f"{n}_top"))]
    return w.groupBy("id").agg(*out)


@query(f"""WITH {NEAR}, h AS (SELECT id, i, any_value(x[i]) + avg(y[i]) AS h FROM (SELECT *, unnest(range(1, 65)) AS i FROM nb) GROUP BY 1, 2),
centre AS (SELECT i, avg(h) AS m, stddev_pop(h) AS s FROM h WHERE id % 5 <> 0 GROUP BY 1) SELECT id, round(sum(power((h - m) / greatest(s, 1e-12), 2)), 5) AS score FROM h JOIN centre USING (i) GROUP BY 1""")
def encoder_round_mean(spark, d):
    """Own features plus the mean of drawn neighbours, averaged over all rounds, standardised on training rows and scored by the distance to their centre."""
    nb = drawn(whole(spark, d))
    pos = nb.select("id", F.posexplode(F.arrays_zip("x", "y")).alias("i", "p"))
    h = pos.groupBy("id", "i").agg((F.max("p.x") + F.avg("p.y")).alias("h"))
    c = h.filter("id % 5 <> 0").groupBy("i").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s"))
    z = (F.col("h") - F.col("m")) / F.greatest(F.col("s"), F.lit(EPS))
    return h.join(F.broadcast(c), "i").groupBy("id").agg(F.round(F.sum(z * z), 5).alias("score"))  # 64 rows


# a fixed linear map to 16 features (sums of four neighbours, halved) stands for trained weights; leaky slope 0.25
LIN = "list_transform(range(16), lambda j: list_sum({}[4 * j + 1 : 4 * j + 4]) / 2)"
LEAKY = "(CASE WHEN {0} > 0 THEN {0} ELSE 0.25 * ({0}) END)"


def linear(x):
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.aggregate(F.slice(x, j * 4 + 1, 4), F.lit(0.0), lambda acc, a: acc + a) / 2)


def leaky(a):
    return F.when(a > 0, a).otherwise(0.25 * a)


@query(f"""WITH {NEAR}, z AS (SELECT id, round, {LIN.format("y")} AS l FROM nb),
q AS (SELECT id, round, list(r ORDER BY j) AS r FROM (SELECT id, round, j, ({LEAKY.format("sum(l[j]) / 5")} + sum({LEAKY.format("l[j] / 2")})) / 5 AS r FROM (SELECT *, unnest(range(1, 17)) AS j FROM z) GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS spot FROM f), n AS (SELECT count(*) AS n FROM f),
d AS (SELECT v.id, list_transform({LIN.format("v.x")}, lambda a: {LEAKY.format("a")}) AS h, round, n, floor({U.format("'cola:' || v.id || ':' || round")} * n)::BIGINT AS drawn, t.spot AS own FROM v LEFT JOIN t USING (id), n, range({ROUNDS}) s(round)),
o AS (SELECT d.id, d.round, d.h, t.id AS other FROM d JOIN t ON t.spot = CASE WHEN d.drawn = d.own THEN (d.drawn + 1) % d.n ELSE d.drawn END)
SELECT o.id, round(avg(list_dot_product(o.h, b.r) - list_dot_product(o.h, a.r)) / 4, 6) AS score FROM o JOIN q a ON a.id = o.id AND a.round = o.round JOIN q b ON b.id = o.other AND b.round = o.round GROUP BY 1""")
def score_cola(spark, d):
    """Context contrast: agreement of a row with the subgraph around a random other training row, less that with its own, averaged over rounds.

    A subgraph is a star of drawn neighbours whose centre is blanked: the centre takes the mean of all nodes, a leaf that of itself and the centre.
    """
    v = whole(spark, d)
    leaves = drawn(v).select("id", "round", F.posexplode(linear(F.col("y"))).alias("j", "l"))
    size = DRAWS + 1
    r = leaves.groupBy("id", "round", "j").agg(((leaky(F.sum("l") / size) + F.sum(leaky(F.col("l") / 2))) / size).alias("r"))
    r = r.groupBy("id", "round").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "r"))), lambda s: s["r"]).alias("r"))
    t = ranking.running_totals(v.filter("id % 5 <> 0").select("id"), "id", {"_n": F.lit(1)}).select("id", (F.col("_n") - 1).alias("spot"))
    rows = v.join(t.withColumnRenamed("spot", "own"), "id", "left").crossJoin(F.broadcast(t.agg(F.count("*").alias("n"))))  # one row
    rows = rows.select("id", F.transform(linear(F.col("x")), leaky).alias("h"), "own", "n", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("round"))
    at = F.floor(fn.u01(F.concat_ws(":", F.lit("cola"), F.col("id").cast("string"), F.col("round").cast("string"))) * F.col("n"))
    rows = rows.withColumn("spot", F.when(at == F.col("own"), (at + 1) % F.col("n")).otherwise(at)).join(t.select("spot", F.col("id").alias("other")), "spot")
    rows = rows.join(r.withColumnRenamed("r", "a"), ["id", "round"]).join(r.select(F.col("id").alias("other"), "round", F.col("r").alias("b")), ["other", "round"])
    return rows.groupBy("id").agg(F.round(F.avg(dot(F.col("h"), F.col("b")) - dot(F.col("h"), F.col("a"))) / 4, 6).alias("score"))


@query(f"""WITH {NEAR}, h AS (SELECT id, j, {LEAKY.format("l[j]")} AS h FROM (SELECT id, {LIN.format("x")} AS l, unnest(range(1, 17)) AS j FROM v)), sc AS (SELECT sqrt(sum(s)) AS scale FROM (SELECT var_pop(h) AS s FROM h GROUP BY j)),
q AS (SELECT i - 1 AS feature, y[i] - x[i] AS dx, list_sum(x[(i - 1) // 4 * 4 + 1 : (i - 1) // 4 * 4 + 4]) / 2 AS pre FROM (SELECT x, y, unnest(range(1, 65)) AS i FROM nb WHERE round = 0 AND slot = 0))
SELECT feature, round(sum(abs({LEAKY.format("(pre + dx / 2)")} - {LEAKY.format("pre")})) / any_value(scale) / sum(abs(dx)), 6) AS gain FROM q, sc WHERE abs(dx) > 1e-9 GROUP BY 1""")
def feature_sensitivity(spark, d):
    """Per feature, how far the embedding moves (in units of its spread) for each unit by which a donor's value changes the feature."""
    v = whole(spark, d)
    h = v.select(F.posexplode(F.transform(linear(F.col("x")), leaky)).alias("j", "h"))
    scale = h.groupBy("j").agg(F.var_pop("h").alias("s")).agg(F.sqrt(F.sum("s")).alias("scale"))
    p = drawn(v).filter("round = 0 and slot = 0").withColumn("l", linear(F.col("x"))).select("l", F.posexplode(F.arrays_zip("x", "y")).alias("feature", "p"))
    q = p.select("feature", (F.col("p.y") - F.col("p.x")).alias("dx"), F.get("l", F.floor(F.col("feature") / 4).cast("int")).alias("pre")).filter(F.abs("dx") > 1e-9)
    moved = F.abs(leaky(F.col("pre") + F.col("dx") / 2) - leaky(F.col("pre")))
    g = q.groupBy("feature").agg(F.sum(moved).alias("z"), F.sum(F.abs("dx")).alias("x")).crossJoin(F.broadcast(scale))  # one row
    return g.select("feature", F.round(F.col("z") / F.col("scale") / F.col("x"), 6).alias("gain"))


@query(f"""WITH {ROWS}, g AS (SELECT *, list_filter(range(1, 65), lambda i: x[i] > 0.1) AS deps FROM b),
p AS (SELECT a.batch, a.pair, c.pair AS other, list_dot_product(a.z, c.z) AS s, CASE WHEN len(a.deps) = 0 OR len(c.deps) = 0 THEN 1.0 ELSE 1 - len(list_intersect(a.deps, c.deps)) / (len(a.deps) + len(c.deps) - len(list_intersect(a.deps, c.deps))) END AS far FROM g a JOIN g c ON a.batch = c.batch WHERE a.k % 2 = 0 AND c.k % 2 = 1),
o AS (SELECT batch, pair, max(s) FILTER (WHERE pair = other) AS pos FROM p GROUP BY 1, 2),
l AS (SELECT batch, pair, ln(any_value(exp(pos / {TAU})) + sum(exp((s + far) / {TAU}))) - any_value(pos) / {TAU} AS nce, avg(greatest(0, s + far - pos)) AS hinge FROM p JOIN o USING (batch, pair) WHERE other <> pair AND pos IS NOT NULL GROUP BY 1, 2)
SELECT batch, round(avg(nce), 6) AS graded_infonce, round(avg(hinge), 6) AS graded_hinge FROM l GROUP BY 1""")
def loss_structure_graded(spark, d):
    """InfoNCE and hinge of each batch whose margin for a negative is its structural distance, 1 - Jaccard of the sets of features above 0.1."""
    deps = F.filter(F.transform("x", lambda a, i: F.when(a > 0.1, i)), lambda i: i.isNotNull())
    b = batches(whole(spark, d)).withColumn("deps", deps)
    p = b.filter("k % 2 = 0").join(_other(b.filter("k % 2 = 1"), "pair", "z", "deps"), "batch")  # 16 partners a row
    common, size = F.size(F.array_intersect("deps", "deps_")), F.size("deps") + F.size("deps_")
    far = F.when((F.size("deps") == 0) | (F.size("deps_") == 0), 1.0).otherwise(1 - common / F.nullif(size - common, F.lit(0)))
    p = p.select("batch", "pair", "pair_", dot(F.col("z"), F.col("z_")).alias("s"), far.alias("far"))
    own = Window.partitionBy("batch", "pair")  # 16 rows
    p = p.withColumn("pos", F.max(F.when(F.col("pair") == F.col("pair_"), F.col("s"))).over(own)).filter("pair <> pair_ and pos is not null")
    nce = F.log(F.exp(F.max("pos") / TAU) + F.sum(F.exp((F.col("s") + F.col("far")) / TAU))) - F.max("pos") / TAU
    rows = p.groupBy("batch", "pair").agg(nce.alias("nce"), F.avg(F.greatest(F.lit(0.0), F.col("s") + F.col("far") - F.col("pos"))).alias("hinge"))
    return rows.groupBy("batch").agg(F.round(F.avg("nce"), 6).alias("graded_infonce"), F.round(F.avg("hinge"), 6).alias("graded_hinge"))
