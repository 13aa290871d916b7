"""Ranking metrics, calibration, ensembles and resampling statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.functions.scalars import precision_at_base_rate, u01
from driftwood.operators import ranking, relational as rel
from driftwood.operators.resampling import MANY, POISSON, bootstrap, bootstrap_ci, multiplicities, resampled_sums
from driftwood.operators.selection import percentiles
from driftwood.plans.registry import query
from driftwood.plans.relational import SEEDS, seeded_scores, sql_u01
from driftwood.sources.scratch import checkpointed
from driftwood.sources.tables import table

#: Score rows: lineitem, positive where returned; positives of one supplier are a family.
SCORES = """s AS (SELECT l_extendedprice AS score, l_returnflag = 'R' AS label, l_suppkey AS family, l_linestatus, l_shipdate, l_quantity,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY l_suppkey, l_returnflag = 'R') ELSE 1.0 END AS w FROM lineitem)"""


def score_rows(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("label"), F.col("l_suppkey").alias("family"), "l_linestatus", "l_shipdate", "l_quantity")
    sizes = li.filter("label").groupBy("family").agg(F.count("*").alias("size"))
    return li.join(sizes, "family", "left").withColumn("w", F.when(F.col("label"), 1.0 / F.col("size")).otherwise(1.0)).drop("size")


def sql_auc(source: str, by: str = "", weight: str = "w", score: str = "score", label: str = "label") -> str:
    g, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""SELECT {g}sum(pos * (cum - neg * 0.5)) / (sum(pos) * sum(neg)) AS auc FROM (
  SELECT *, sum(neg) OVER ({p}ORDER BY {score}) AS cum FROM (
    SELECT {g}{score}, sum(CASE WHEN {label} THEN {weight} ELSE 0 END) AS pos, sum(CASE WHEN {label} THEN 0 ELSE {weight} END) AS neg FROM {source} GROUP BY {g}{score})) {f"GROUP BY {by}" if by else ""}"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {SCORES} SELECT round(auc, 6) AS auc FROM ({sql_auc('s')})")
def metric_auc_weighted(spark, d):
    return rounded(ranking.auc(score_rows(spark, d), "score", F.col("label"), F.col("w")), "auc").select("auc")


@query(f"""WITH {SCORES}, t AS (SELECT score, sum(label::INT) AS pos, sum((NOT label)::INT) AS neg FROM s GROUP BY 1),
c AS (SELECT *, sum(pos) OVER () AS p, sum(neg) OVER () AS n, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM t),
r AS (SELECT (fp - neg) / n AS f0, (tp - pos) / p AS t0, fp / n AS f1, tp / p AS t1 FROM c),
a AS (SELECT sum(CASE WHEN f1 <= 0.05 THEN (f1 - f0) * (t0 + t1) / 2 WHEN f0 < 0.05 THEN (0.05 - f0) * (t0 + (t1 - t0) / (f1 - f0) * (0.05 - f0) / 2) ELSE 0 END) AS a FROM r)
SELECT round(0.5 * (1 + (a - 0.00125) / (0.05 - 0.00125)), 6) AS pauc FROM a""")
def metric_partial_auc(spark, d):
    return rounded(ranking.partial_auc(score_rows(spark, d), "score", F.col("label"), 0.05), "pauc")


ALPHAS = [0.002, 0.005, 0.01, 0.02, 0.05]
CAUGHT = """SELECT alpha::DOUBLE AS alpha, round(avg((score > t)::INT) FILTER (WHERE label), 6) AS tpr, round(sum(w) FILTER (WHERE label AND score > t) / sum(w) FILTER (WHERE label), 6) AS tpr_w,
  round(avg((score > t)::INT) FILTER (WHERE NOT label), 6) AS fpr FROM s, th GROUP BY alpha"""


def sql_thresholds(source: str, alphas: list[float]) -> str:
    return f"th AS (SELECT unnest({alphas})::DOUBLE AS alpha, unnest(q) AS t FROM (SELECT quantile_cont(score, {[1 - a for a in alphas]}) AS q FROM {source} WHERE NOT label))"


@query(f"WITH {SCORES}, th AS (SELECT 0.01::DOUBLE AS alpha, quantile_cont(score, 0.99) AS t FROM s WHERE NOT label) {CAUGHT}")
def metric_tpr_at_fpr(spark, d):
    s = score_rows(spark, d)
    return rounded(ranking.caught(s, ranking.thresholds(s, "score", F.col("label"), [0.01]), "score", F.col("label"), F.col("w")), "tpr", "tpr_w", "fpr")


#: Fifteen points in geometric steps from 0.2 to 5 %, and those that tables report.
CURVE = sorted({*(round(0.002 * 25 ** (k / 14), 12) for k in range(15)), 0.01, 0.02, 0.05})


@query(f"WITH {SCORES}, {sql_thresholds('s', CURVE)} {CAUGHT}")
def metric_operating_curve(spark, d):
    s = score_rows(spark, d)
    limits = ranking.thresholds(s, "score", F.col("label"), CURVE)
    return rounded(ranking.caught(s, limits, "score", F.col("label"), F.col("w")), "tpr", "tpr_w", "fpr")


@query(f"""WITH {SCORES.replace('s AS', 'a AS')}, v AS (SELECT * FROM a WHERE l_linestatus = 'O'), s AS (SELECT * FROM a WHERE l_linestatus = 'F'),
{sql_thresholds('v', ALPHAS)} {CAUGHT}""")
def metric_preset_threshold(spark, d):
    s = score_rows(spark, d)
    limits = ranking.thresholds(s.filter("l_linestatus = 'O'"), "score", F.col("label"), ALPHAS)
    return rounded(ranking.caught(s.filter("l_linestatus = 'F'"), limits, "score", F.col("label"), F.col("w")), "tpr", "tpr_w", "fpr")


def _prec(name: str, tpr: str, per: int) -> str:
    return f"round({tpr} / {1 + per}.0 / ({tpr} / {1 + per}.0 + 0.01 * {per} / {1 + per}.0), 6) AS {name}"


@query(f"""WITH {SCORES}, q AS (SELECT quantile_cont(score, 0.99) AS t FROM s WHERE NOT label),
c AS (SELECT avg((score > t)::INT) FILTER (WHERE label) AS tpr, sum(w) FILTER (WHERE label AND score > t) / sum(w) FILTER (WHERE label) AS tpr_w FROM s, q)
SELECT {_prec("prec65", "tpr", 65)}, {_prec("prec2000", "tpr", 2000)}, {_prec("prec65_fw", "tpr_w", 65)}, {_prec("prec2000_fw", "tpr_w", 2000)} FROM c""")
def metric_precision_base_rate(spark, d):
    s = score_rows(spark, d)
    c = ranking.caught(s, ranking.thresholds(s, "score", F.col("label"), [0.01]), "score", F.col("label"), F.col("w"))
    return c.select(*(F.round(precision_at_base_rate(F.col(x), 0.01, per), 6).alias(f"prec{per}{tail}") for x, tail in (("tpr", ""), ("tpr_w", "_fw")) for per in (65, 2000)))


@query("""SELECT round(p65, 9) AS own_fpr, round(p2000, 9) AS own_fpr_rare FROM (SELECT 0.9 / 66 * (1 / 0.6 - 1) / (65 / 66.0) AS p65, 0.9 / 2001 * (1 / 0.05 - 1) / (2000 / 2001.0) AS p2000)""")
def metric_inverse_base_rate(spark, d):
    """The false-positive rate that gives a stored precision at a stored recall and base rate."""

    def own(tpr, precision, per):
        p = 1 / (1 + per)
        return F.round(F.lit(tpr) * p * (1 / F.lit(precision) - 1) / (1 - p), 9)

    return spark.range(1).select(own(0.9, 0.6, 65).alias("own_fpr"), own(0.9, 0.05, 2000).alias("own_fpr_rare"))


def sql_suite(source: str) -> str:
    return f"""SELECT count(*) FILTER (WHERE label) AS n_pos, count(*) FILTER (WHERE NOT label) AS n_neg,
 round(avg((score > q1)::INT) FILTER (WHERE label), 6) AS tpr1, round(avg((score > q5)::INT) FILTER (WHERE label), 6) AS tpr5,
 round(sum(w) FILTER (WHERE label AND score > q1) / sum(w) FILTER (WHERE label), 6) AS tpr1_fw,
 round(avg((score > q1)::INT) FILTER (WHERE label AND l_quantity <= 25), 6) AS tpr1_hard
 FROM {source} s, (SELECT quantile_cont(score, 0.99) AS q1, quantile_cont(score, 0.95) AS q5 FROM {source} WHERE NOT label)"""


def suite(s, by=()):
    label = F.col("label")
    q = percentiles(s.filter(~label), "score", [0.99, 0.95], by)
    s = s.join(F.broadcast(q), list(by)) if by else s.crossJoin(q)  # q: one row for each group
    hit = F.col("score") > F.col("q")[0]
    share = lambda above, rows: F.round(F.avg(F.when(rows, above.cast("int"))), 6)
    return s.groupBy(*by).agg(
        F.count_if(label).alias("n_pos"), F.count_if(~label).alias("n_neg"), share(hit, label).alias("tpr1"), share(F.col("score") > F.col("q")[1], label).alias("tpr5"),
        F.round(F.sum(F.when(label & hit, F.col("w"))) / F.sum(F.when(label, F.col("w"))), 6).alias("tpr1_fw"), share(hit, label & (F.col("l_quantity") <= 25)).alias("tpr1_hard"),
    )


@query(f"WITH {SCORES} SELECT * FROM ({sql_suite('s')}), (SELECT round(auc, 6) AS auc FROM ({sql_auc('s')})), (SELECT round(auc, 6) AS auc_hard FROM ({sql_auc('(SELECT * FROM s WHERE NOT label OR l_quantity <= 25)')}))")
def metric_point_suite(spark, d):
    s = score_rows(spark, d)
    a = ranking.auc(s, "score", F.col("label"), F.col("w")).select(F.round("auc", 6).alias("auc"))
    hard = ranking.auc(s.filter("not label or l_quantity <= 25"), "score", F.col("label"), F.col("w")).select(F.round("auc", 6).alias("auc_hard"))
    return suite(s).crossJoin(a).crossJoin(hard)  # of one row each


@query(f"""WITH {SCORES}, q AS (SELECT l_linestatus, quantile_cont(score, 0.99) FILTER (WHERE NOT label) AS t FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE NOT label) >= 50 AND count(*) FILTER (WHERE label) >= 20),
g AS (SELECT quantile_cont(score, 0.99) AS tg FROM s WHERE NOT label), a AS ({sql_auc('s', 'l_linestatus')})
SELECT l_linestatus, round(any_value(auc), 6) AS auc, round(avg((score > t)::INT) FILTER (WHERE label), 6) AS tpr_inside, round(avg((score > tg)::INT) FILTER (WHERE label), 6) AS tpr_global
FROM s JOIN q USING (l_linestatus) JOIN a USING (l_linestatus), g GROUP BY 1""")
def metric_subgroups(spark, d):
    s, label = score_rows(spark, d), F.col("label")
    enough = s.groupBy("l_linestatus").agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n")).filter("n >= 50 and p >= 20")
    q = percentiles(s.filter(~label), "score", [0.99], ["l_linestatus"]).join(enough, "l_linestatus", "left_semi").select("l_linestatus", F.col("q")[0].alias("t"))
    g = percentiles(s.filter(~label), "score", [0.99]).select(F.col("q")[0].alias("tg"))
    a = ranking.auc(s, "score", label, F.col("w"), ["l_linestatus"]).select("l_linestatus", F.round("auc", 6).alias("auc"))
    share = lambda t: F.round(F.avg(F.when(label, (F.col("score") > F.col(t)).cast("int"))), 6)
    return s.join(F.broadcast(q), "l_linestatus").crossJoin(g).groupBy("l_linestatus").agg(share("t").alias("tpr_inside"), share("tg").alias("tpr_global")).join(a, "l_linestatus")


POPULATION = "CASE WHEN l_shipdate < TIMESTAMP '1994-01-01' THEN 'established' WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'later' ELSE 'new' END"


@query(f"WITH {SCORES}, p AS (SELECT *, {POPULATION} AS population FROM s), k AS (SELECT population FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE label) >= 20 AND count(*) FILTER (WHERE NOT label) >= 20) SELECT population, round(auc, 6) AS auc FROM ({sql_auc('p', 'population')}) WHERE population IN (FROM k)")
def metric_population(spark, d):
    s = score_rows(spark, d).withColumn("population", F.expr(POPULATION))
    enough = s.groupBy("population").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n")).filter("p >= 20 and n >= 20")
    a = ranking.auc(s, "score", F.col("label"), F.col("w"), ["population"])
    return a.join(enough, "population", "left_semi").select("population", F.round("auc", 6).alias("auc"))


@query("SELECT o_orderkey, round((rank() OVER w + (count(*) OVER (PARTITION BY floor(o_totalprice / 1000)) - 1) / 2.0) / count(*) OVER (), 9) AS pct FROM orders WINDOW w AS (ORDER BY floor(o_totalprice / 1000))")
def win_midrank(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("k"))
    return ranking.midrank(o, "k").select("o_orderkey", F.round("pct", 9).alias("pct"))


@query("""WITH b AS (SELECT 'val' AS part, o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'test', o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'),
r AS (SELECT part, id, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER () AS pct FROM b) SELECT id, round(pct, 9) AS pct FROM r WHERE part = 'test'""")
def win_joint_rank(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.when(F.col("o_orderstatus") == "F", "val").otherwise("test").alias("part"))
    return ranking.midrank(o, "v").filter("part = 'test'").select("id", F.round("pct", 9).alias("pct"))


ENSEMBLE = f"""r AS (SELECT o_orderkey, seed, (rank() OVER (PARTITION BY seed ORDER BY score) + 0.0) / count(*) OVER (PARTITION BY seed) AS pct FROM {SEEDS}), e AS (SELECT o_orderkey, avg(pct) AS score FROM r GROUP BY 1)"""


def ensemble(spark, d):
    return ranking.midrank(seeded_scores(spark, d), "score", ["seed"]).groupBy("o_orderkey").agg(F.avg("pct").alias("score"))


@query(f"WITH {ENSEMBLE} SELECT o_orderkey, round(score, 9) AS score FROM e")
def metric_rank_ensemble(spark, d):
    return ensemble(spark, d).select("o_orderkey", F.round("score", 9).alias("score"))


@query(f"WITH {ENSEMBLE}, s AS (SELECT round(score, 9) AS score, o_orderpriority < '2' AS label FROM e JOIN orders USING (o_orderkey)), q AS (SELECT quantile_cont(score, 0.95) AS t FROM s WHERE NOT label) SELECT round(avg((score > t)::INT) FILTER (WHERE label), 6) AS tpr FROM s, q")
def metric_ensemble_caught(spark, d):
    s = ensemble(spark, d).select("o_orderkey", F.round("score", 9).alias("score")).join(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderpriority") < "2").alias("label")), "o_orderkey")
    s = checkpointed(s.select("score", "label"))  # thresholds and shares both read it
    return ranking.caught(s, ranking.thresholds(s, "score", F.col("label"), [0.05]), "score", F.col("label")).select(F.round("tpr", 6).alias("tpr"))


TAIL = """(SELECT q.*, -ln((1 + (SELECT count(*) FROM {r} x WHERE x.score >= q.score)) / (1 + n)::DOUBLE) + 1e-3 * least(greatest((q.score - mid) / greatest(hi - mid, 1e-12), -1e3), 1e3) AS cal
 FROM {q} q, (SELECT count(*) AS n, median(score) AS mid, quantile_cont(score, 0.99) AS hi FROM {r}))"""
CALIBRATED = f"""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS score, CASE WHEN o_custkey % 2 = 0 THEN 'peers' ELSE 'none' END AS grp, o_orderstatus = 'F' AS ref FROM orders),
p AS (SELECT * FROM a WHERE ref AND grp = 'peers'), n AS (SELECT * FROM a WHERE ref AND grp = 'none'),
qp AS (SELECT * FROM a WHERE NOT ref AND grp = 'peers'), qn AS (SELECT * FROM a WHERE NOT ref AND grp = 'none')
SELECT id, grp, round(cal, 6) AS calibrated FROM {TAIL.format(r='p', q='qp')} UNION ALL SELECT id, grp, round(cal, 6) FROM {TAIL.format(r='n', q='qn')}"""


@query(CALIBRATED)
def metric_calibrated_combine(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.when(F.col("o_custkey") % 2 == 0, "peers").otherwise("none").alias("grp"), (F.col("o_orderstatus") == "F").alias("ref"))
    parts = []
    for g in ("peers", "none"):
        own = a.filter(F.col("grp") == g)
        parts.append(ranking.tail_score(own.filter("ref").select("score"), own.filter("not ref"), "score"))
    return rel.union_all(*parts).select("id", "grp", F.round("calibrated", 6).alias("calibrated"))


@query(f"""WITH {ENSEMBLE}, b AS (SELECT o_orderkey, (rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / count(*) OVER () AS other FROM orders)
SELECT o_orderkey, round(0.5 * score + 0.5 * other, 6) AS avg50, round(0.25 * score + 0.75 * other, 6) AS avg25, round(CASE WHEN o_orderkey % 3 = 0 THEN other ELSE score END, 6) AS connected_only FROM e JOIN b USING (o_orderkey)""")
def metric_complementarity(spark, d):
    b = ranking.midrank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", name="other")
    s, o = F.col("score"), F.col("other")
    return ensemble(spark, d).join(b, "o_orderkey").select("o_orderkey", F.round(0.5 * s + 0.5 * o, 6).alias("avg50"), F.round(0.25 * s + 0.75 * o, 6).alias("avg25"), F.round(F.when(F.col("o_orderkey") % 3 == 0, o).otherwise(s), 6).alias("connected_only"))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""WITH long AS (UNPIVOT (SELECT l_returnflag = 'R' AS label, {", ".join(f"{c}::DOUBLE AS {c}" for c in NUMERIC)} FROM lineitem) ON {", ".join(NUMERIC)} INTO NAME feature VALUE value),
a AS ({sql_auc('long', 'feature', '1.0', 'value')}), m AS (SELECT feature, avg(value) FILTER (WHERE label) AS mean_pos, avg(value) FILTER (WHERE NOT label) AS mean_neg FROM long GROUP BY 1)
SELECT feature, round(greatest(auc, 1 - auc), 6) AS separability, auc >= 0.5 AS higher, round(mean_pos, 4) AS mean_pos, round(mean_neg, 4) AS mean_neg FROM a JOIN m USING (feature)""")
def metric_feature_separability(spark, d):
    long = rel.unpivot(table(spark, d, "lineitem").withColumn("label", F.col("l_returnflag") == "R"), ["label"], NUMERIC)
    a = ranking.auc(long, "value", F.col("label"), None, ["feature"])
    m = long.groupBy("feature").agg(F.avg(F.when(F.col("label"), F.col("value"))).alias("p"), F.avg(F.when(~F.col("label"), F.col("value"))).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo < hi")
    return a.join(m, "feature").select("feature", F.round(F.greatest(F.col("auc"), 1 - F.col("auc")), 6).alias("separability"), (F.col("auc") >= 0.5).alias("higher"), F.round("p", 4).alias("mean_pos"), F.round("n", 4).alias("mean_neg"))


@query("""WITH r AS (SELECT (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) AS a, (rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) AS b FROM part)
SELECT round(corr(a, b), 6) AS rho FROM r""")
def metric_spearman(spark, d):
    return rounded(ranking.spearman(table(spark, d, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")), "a", "b"), "rho")


P_VALUES = f"SELECT p_brand AS family, p_partkey AS id, {sql_u01("'p:' || p_partkey")} * {sql_u01("'q:' || p_partkey")} AS p FROM part"


@query(f"WITH t AS ({P_VALUES}), r AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER w + 1) * p AS step FROM t WINDOW w AS (PARTITION BY family ORDER BY p)) SELECT family, id, p, least(max(step) OVER (PARTITION BY family ORDER BY p), 1.0) AS p_holm FROM r")
def test_holm(spark, d):
    key = F.col("p_partkey").cast("string")
    t = table(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"), (u01(F.concat(F.lit("p:"), key)) * u01(F.concat(F.lit("q:"), key))).alias("p"))
    return ranking.holm(t, "p", ["family"])


BOOT = 20
DRAWN = f"""r AS (SELECT l_extendedprice AS score, l_returnflag = 'R' AS label, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY l_suppkey, l_returnflag = 'R') ELSE 1.0 END AS w,
  CASE WHEN l_returnflag = 'R' THEN 'family:' || l_suppkey ELSE 'row:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey END AS key FROM lineitem),
h AS (SELECT *, [sha256(k || ':' || key) for k in range({-(-BOOT // 16)})] AS hs FROM r),
d AS (SELECT b, score, label, w, len([t for t in {POISSON} if t <= ('0x' || substr(hs[1 + b // 16], (1 + 4 * (b % 16))::INT, 4))::INT]) AS times FROM h, range({BOOT}) x(b)),
g AS (SELECT b, score, sum(CASE WHEN label THEN w * times ELSE 0 END) AS p, sum(CASE WHEN label THEN 0 ELSE times END) AS n FROM d GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY b ORDER BY score) AS c, sum(n) OVER (PARTITION BY b) AS all_n, sum(p) OVER (PARTITION BY b) AS all_p FROM g),
q AS (SELECT b, any_value((all_n - 1) * (1 - 0.01::DOUBLE)) AS place, min(score) FILTER (WHERE c >= floor((all_n - 1) * (1 - 0.01::DOUBLE)) + 1) AS l, min(score) FILTER (WHERE c >= floor((all_n - 1) * (1 - 0.01::DOUBLE)) + 2) AS u, sum(p * (c - n * 0.5)) / any_value(all_p * all_n) AS auc FROM c GROUP BY b),
t AS (SELECT b, any_value(auc) AS auc, sum(CASE WHEN score > l + (place - floor(place)) * (coalesce(u, l) - l) THEN p ELSE 0 END) / any_value(all_p) AS tpr FROM c JOIN q USING (b) GROUP BY b)"""
INTERVAL = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{name}" for c in ("auc", "tpr") for q, name in ((0.025, "lo"), (0.975, "hi")))


def interval(spark, d, resamples):
    li = table(spark, d, "lineitem").withColumn("label", F.col("l_returnflag") == "R")
    sizes = li.filter("label").groupBy("l_suppkey").agg(F.count("*").alias("size"))
    s = li.join(sizes, "l_suppkey", "left")
    row = F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")))
    out = bootstrap_ci(s, "l_extendedprice", F.col("label"), F.when(F.col("label"), 1.0 / F.col("size")).otherwise(1.0), F.col("l_suppkey"), row, resamples, block=MANY if resamples > BOOT else 16)
    return rounded(out, "auc_lo", "auc_hi", "tpr_lo", "tpr_hi")


@query(f"WITH {DRAWN} SELECT {INTERVAL}, count(*) AS resamples FROM t")
def boot_ci(spark, d):
    """Intervals over resamples of the families of positives and of each negative."""
    return interval(spark, d, BOOT)


#: Resamples of a full run.
ALL_RESAMPLES = 5000


def family_auc_ci(scores, resamples):
    """lo and hi of the AUC where only the families of positives are drawn (boot_ci draws the negatives too).

    Negatives are the same in every resample, so each family's share of the area is computed once and weighted.
    """
    s = ranking.running_totals(ranking.steps(scores, "score", F.col("label"), F.col("w")).select("score", "neg"), "score", {"cum": F.col("neg")})
    total = s.agg(F.sum("neg").alias("all"))
    below = s.crossJoin(F.broadcast(total)).select("score", ((F.col("cum") - F.col("neg") * 0.5) / F.col("all")).alias("below"))
    pos = scores.filter("label").join(below, "score").groupBy("family").agg(F.sum(F.col("w") * F.col("below")).alias("area"), F.sum("w").alias("w"))
    drawn = multiplicities(scores.filter("label").select("family").distinct(), "family", "boot", resamples)
    a = drawn.join(pos, "family").groupBy("b").agg((F.sum(F.col("times") * F.col("area")) / F.sum(F.col("times") * F.col("w"))).alias("auc"))
    return a.agg(F.round(F.percentile("auc", 0.025), 6).alias("lo"), F.round(F.percentile("auc", 0.975), 6).alias("hi"), F.count("*").alias("resamples"))


@query()
def boot_ci_5000(spark, d):
    """boot_ci with the resamples of a full run, too many for its SQL."""
    return interval(spark, d, ALL_RESAMPLES)


PAIRED = f"""WITH v AS (SELECT seed, o_custkey, o_orderpriority < '2' AS label, score AS a, (score + {sql_u01("'b' || seed || ':' || o_orderkey")}) / 2 AS b FROM {SEEDS}),
fam AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM v WHERE label)),
d1 AS (SELECT r, floor({sql_u01("'pair:' || r || ':' || pos")} * n)::BIGINT AS pick FROM fam, range({BOOT}) t(r)),
ft AS (SELECT r, o_custkey, count(*) AS ft FROM d1 JOIN fam ON pos = pick GROUP BY ALL),
d2 AS (SELECT r, floor({sql_u01("'seed:' || r || ':' || j")} * 3)::BIGINT AS seed FROM range({BOOT}) t(r), range(3) u(j)), st AS (SELECT r, seed, count(*) AS st FROM d2 GROUP BY ALL),
q AS (SELECT seed, quantile_cont(a, 0.95) AS qa, quantile_cont(b, 0.95) AS qb FROM v WHERE NOT label GROUP BY 1),
hit AS (SELECT seed, o_custkey, sum((a > qa)::INT) AS ha, sum((b > qb)::INT) AS hb, count(*) AS n FROM v JOIN q USING (seed) WHERE label GROUP BY ALL),
diffs AS (SELECT r, sum(st * ft * (ha - hb)) / sum(st * ft * n) AS d FROM hit JOIN ft USING (o_custkey) JOIN st USING (r, seed) GROUP BY r)
SELECT round(avg(d), 6) AS diff, round(quantile_cont(d, 0.025), 6) AS ci_lo, round(quantile_cont(d, 0.975), 6) AS ci_hi,
 round(least(1.0, 2 * least(1 + sum((d <= 0)::INT), 1 + sum((d >= 0)::INT)) / ({BOOT} + 1.0)), 6) AS p FROM diffs"""


def paired_difference(spark, d, resamples):
    """Difference of two scorers' caught shares over shared resamples of families and of seeds."""
    v = seeded_scores(spark, d).withColumns({"label": F.col("o_orderpriority") < "2", "a": F.col("score")})
    v = v.withColumn("b", (F.col("score") + u01(F.concat(F.lit("b"), F.col("seed").cast("string"), F.lit(":"), F.col("o_orderkey").cast("string")))) / 2)
    clean = v.filter("not label")
    q = percentiles(clean, "a", [0.95], ["seed"]).select("seed", F.col("q")[0].alias("qa")).join(percentiles(clean, "b", [0.95], ["seed"]).select("seed", F.col("q")[0].alias("qb")), "seed")
    known = F.col("o_custkey").isNotNull() & F.col("qa").isNotNull()
    of_seed = lambda k: [(F.count_if(known & (F.col("seed") == k) & (F.col("a") > F.col("qa"))) - F.count_if(known & (F.col("seed") == k) & (F.col("b") > F.col("qb")))).alias(f"more_{k}"), F.count_if(known & (F.col("seed") == k)).alias(f"n_{k}")]
    hit = v.filter("label").join(F.broadcast(q), "seed", "left").groupBy("o_custkey").agg(*(c for k in range(3) for c in of_seed(k)))
    sums = resampled_sums(hit, "o_custkey", "pair", resamples)
    draws = [F.floor(u01(F.concat_ws(":", F.lit("seed"), F.col("b").cast("string"), F.lit(str(j)))) * 3) for j in range(3)]
    times = [sum((x == k).cast("int") for x in draws) for k in range(3)]
    diffs = sums.select(F.try_divide(sum(t * F.col(f"more_{k}") for k, t in enumerate(times)), sum(t * F.col(f"n_{k}") for k, t in enumerate(times))).alias("d"))
    p = 2 * F.least(1 + F.count_if(F.expr("d <= 0")), 1 + F.count_if(F.expr("d >= 0"))) / (resamples + 1.0)
    return diffs.agg(F.round(F.avg("d"), 6).alias("diff"), F.round(F.percentile("d", 0.025), 6).alias("ci_lo"), F.round(F.percentile("d", 0.975), 6).alias("ci_hi"), F.round(F.least(F.lit(1.0), p), 6).alias("p"))


@query(PAIRED)
def boot_paired(spark, d):
    return paired_difference(spark, d, BOOT)


def paired_test(scores, by: list[int], resamples: int, seed_key: str = "seed", fpr: float = 0.05):
    """(diff, ci_lo, ci_hi, p) of the share that a catches over that of b, from scores(seed, id, family, label, a, b).

    Every resample draws families of positives, single negatives and seeds, the same for both scorers; each has the
    threshold of the resample's own negatives.  p is two-sided, with one added to either tail.
    """
    out = None
    for k in by:
        own = scores.filter(F.col("seed") == k)
        one = None
        for c in ("a", "b"):
            r = bootstrap(own, c, F.col("label"), F.lit(1.0), F.col("family"), F.col("id").cast("string"), resamples, fpr, MANY).select("b", F.col("tpr").alias(f"tpr_{c}"))
            one = r if one is None else one.join(r, "b")
        one = one.withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    n = len(by)
    draws = F.transform(F.array(*map(F.lit, range(n))), lambda j: F.floor(u01(F.concat_ws(":", F.lit(seed_key), F.col("b").cast("string"), j.cast("string"))) * n))
    times = F.size(F.filter(draws, lambda at: at == F.array_position(F.array(*map(F.lit, by)), F.col("k")) - 1))
    diffs = out.withColumn("times", times).groupBy("b").agg((F.sum(F.col("times") * (F.col("tpr_a") - F.col("tpr_b"))) / n).alias("d"))
    p = 2 * F.least(1 + F.count_if(F.expr("d <= 0")), 1 + F.count_if(F.expr("d >= 0"))) / (F.count("d") + 1.0)
    return diffs.agg(F.avg("d").alias("diff"), F.percentile("d", 0.025).alias("ci_lo"), F.percentile("d", 0.975).alias("ci_hi"), F.least(F.lit(1.0), p).alias("p"), F.count("d").alias("resamples"))


@query()
def boot_paired_5000(spark, d):
    """Paired test of two scorers with the resamples of a full run: families, negatives and seeds are drawn, thresholds are each resample's own."""
    v = seeded_scores(spark, d).withColumns({"label": F.col("o_orderpriority") < "2", "a": F.col("score"), "family": F.col("o_custkey"), "id": F.col("o_orderkey")})
    v = v.withColumn("b", (F.col("score") + u01(F.concat(F.lit("b"), F.col("seed").cast("string"), F.lit(":"), F.col("o_orderkey").cast("string")))) / 2)
    return rounded(paired_test(v, [0, 1, 2], ALL_RESAMPLES), "diff", "ci_lo", "ci_hi", "p")


@query(f"""WITH v AS (SELECT seed, o_orderpriority, {sql_u01("'v' || seed || o_orderpriority")} AS val FROM {SEEDS} GROUP BY ALL), m AS (SELECT o_orderpriority AS method, avg(val) AS val FROM v GROUP BY 1)
SELECT method, round(val, 6) AS val FROM m ORDER BY val DESC, method LIMIT 1""")
def metric_best_of(spark, d):
    """The candidate of best mean validation score; of equals, the first in candidate order."""
    v = seeded_scores(spark, d).select("seed", "o_orderpriority").distinct()
    v = v.withColumn("val", u01(F.concat(F.lit("v"), F.col("seed").cast("string"), "o_orderpriority")))
    return v.groupBy(F.col("o_orderpriority").alias("method")).agg(F.avg("val").alias("val")).orderBy(F.desc("val"), "method").limit(1).select("method", F.round("val", 6).alias("val"))


@query(f"""WITH v AS (SELECT seed, o_custkey, o_orderpriority, o_orderpriority < '3' AS label, score FROM {SEEDS}), q AS (SELECT seed, quantile_cont(score, 0.95) AS t FROM v WHERE NOT label GROUP BY 1),
f AS (SELECT seed, o_orderpriority, o_custkey, avg((score > t)::INT) AS c FROM v JOIN q USING (seed) WHERE label GROUP BY ALL), g AS (SELECT seed, o_orderpriority, avg(c) AS c FROM f GROUP BY ALL)
SELECT o_orderpriority, round(avg(c), 6) AS caught_fw FROM g GROUP BY 1""")
def metric_caught_by_group(spark, d):
    """Share caught in each candidate group, every family counting once, mean over seeds."""
    v = seeded_scores(spark, d).withColumn("label", F.col("o_orderpriority") < "3")
    q = percentiles(v.filter("not label"), "score", [0.95], ["seed"]).select("seed", F.col("q")[0].alias("t"))
    f = v.filter("label").join(F.broadcast(q), "seed").groupBy("seed", "o_orderpriority", "o_custkey").agg(F.avg((F.col("score") > F.col("t")).cast("int")).alias("c"))
    return f.groupBy("seed", "o_orderpriority").agg(F.avg("c").alias("c")).groupBy("o_orderpriority").agg(F.round(F.avg("c"), 6).alias("caught_fw"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(s, min(s) OVER () - 1) AS score FROM (SELECT *, CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice END AS s FROM lineitem)")
def metric_unscorable_fill(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice")).alias("s"))
    return li.crossJoin(li.agg((F.min("s") - 1).alias("least"))).select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce("s", "least").alias("score"))


@query("SELECT o_orderkey, floor(o_totalprice / 50000)::BIGINT + (o_totalprice > 200000)::INT AS score, (o_totalprice > 200000) AS rule FROM orders")
def det_rule_score(spark, d):
    """Findings, and one more where the rule fires."""
    fires = F.col("o_totalprice") > 200000
    return table(spark, d, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice") / 50000) + fires.cast("int")).cast("bigint").alias("score"), fires.alias("rule"))


@query(f"""WITH c AS (SELECT seed, o_orderpriority, (score * 10)::INT AS cand, score, o_orderstatus = 'F' AS label FROM {SEEDS} JOIN (SELECT o_orderkey, o_orderstatus FROM orders) USING (o_orderkey)),
a AS (SELECT o_orderpriority AS setting, avg(CASE WHEN label THEN score END) - avg(CASE WHEN NOT label THEN score END) AS val FROM c WHERE seed = 0 GROUP BY 1)
SELECT setting, round(val, 6) AS val FROM a ORDER BY val DESC, setting LIMIT 1""")
def det_grid_selection(spark, d):
    """The setting chosen on the first seed's validation figure; other seeds reuse it."""
    c = seeded_scores(spark, d).filter("seed = 0").join(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("label")), "o_orderkey")
    val = F.avg(F.when(F.col("label"), F.col("score"))) - F.avg(F.when(~F.col("label"), F.col("score")))
    return c.groupBy(F.col("o_orderpriority").alias("setting")).agg(val.alias("val")).orderBy(F.desc("val"), "setting").limit(1).select("setting", F.round("val", 6).alias("val"))


@query(f"""WITH {SCORES}, a AS ({sql_auc('s', weight='1.0')}), q AS (SELECT quantile_cont(score, 0.99) AS q1, quantile_cont(score, 0.95) AS q5 FROM s WHERE NOT label),
t AS (SELECT avg((score > q1)::INT) AS tpr1, avg((score > q5)::INT) AS tpr5 FROM s, q WHERE label)
SELECT round(auc, 6) AS auc, round(tpr1, 6) AS tpr1, round(tpr5, 6) AS tpr5, {_prec("prec200", "tpr1", 200)}, {_prec("prec1000", "tpr1", 1000)} FROM a, t""")
def metric_earlier_evaluation(spark, d):
    s = score_rows(spark, d)
    c = ranking.caught(s, ranking.thresholds(s, "score", F.col("label"), [0.01, 0.05]), "score", F.col("label"))
    t = c.agg(F.max(F.when(F.col("alpha") == 0.01, F.col("tpr"))).alias("tpr1"), F.max(F.when(F.col("alpha") == 0.05, F.col("tpr"))).alias("tpr5"))
    a = ranking.auc(s, "score", F.col("label")).select("auc")
    return a.crossJoin(t).select(F.round("auc", 6).alias("auc"), F.round("tpr1", 6).alias("tpr1"), F.round("tpr5", 6).alias("tpr5"), *(F.round(precision_at_base_rate(F.col("tpr1"), 0.01, n), 6).alias(f"prec{n}") for n in (200, 1000)))
