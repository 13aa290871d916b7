"""The flagship report, and detectors over feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.functions import scalars as fn
from driftwood.operators import detectors as det, ranking
from driftwood.operators.scaling import robust
from driftwood.plans.registry import query
from driftwood.sources.scratch import checkpointed
from driftwood.sources.tables import table

FEATURES = ["n_len", "max_line", "entropy", "symbols"]


FLAGSHIP = r"""WITH f AS (SELECT d.doc_id, d.lang, l.toxic, l.quality, d.text, ('0x' || substr(sha256('f:' || d.doc_id), 1, 15))::BIGINT / 1152921504606846976.0 AS u,
  sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9+/=]{200,}', '<BLOB>', 'g'), '\s+', '', 'g')) AS family FROM documents d JOIN labels l USING (doc_id)),
ch AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM f) WHERE c <> '' GROUP BY ALL), e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM ch GROUP BY 1),
x AS (SELECT f.*, ln(1 + length(text)) AS n_len, ln(1 + list_max([length(s) for s in string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))])) AS max_line, ln(1 + coalesce(e.entropy, 0)) AS entropy,
  ln(1 + CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[A-Za-z0-9\s]', '', 'g')) / length(text) ELSE 0 END) AS symbols FROM f LEFT JOIN e USING (doc_id)),
q AS (SELECT """ + ", ".join(f"median({c}) AS m{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i{c}" for c in FEATURES) + """ FROM x WHERE u < 0.5 AND quality = 1 AND toxic = 0),
s AS (SELECT doc_id, lang, toxic = 1 AS label, round(""" + " + ".join(f"abs(({c} - m{c}) / (CASE WHEN i{c} = 0 THEN 1 ELSE i{c} / 1.349 END))" for c in FEATURES) + """, 6) AS score, 1.0::DOUBLE / count(*) OVER (PARTITION BY family) AS w FROM x, q),
g AS (SELECT 'all' AS lang, label, score, w FROM s UNION ALL SELECT lang, label, score, w FROM s), t AS (SELECT lang, score, sum(CASE WHEN label THEN w ELSE 0 END) AS pos, sum(CASE WHEN label THEN 0 ELSE w END) AS neg FROM g GROUP BY ALL),
a AS (SELECT lang, sum(pos * (cum - neg * 0.5)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY lang ORDER BY score) AS cum FROM t) GROUP BY 1),
h AS (SELECT lang, quantile_cont(score, 0.9) FILTER (WHERE NOT label) AS t FROM g GROUP BY 1)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE label) AS positives, round(any_value(auc), 5) AS auc, round(sum(w) FILTER (WHERE label AND score > t) / sum(w) FILTER (WHERE label), 5) AS caught10
FROM g JOIN a USING (lang) JOIN h USING (lang) GROUP BY 1 HAVING lang = 'all' OR (count(*) FILTER (WHERE label) >= 5 AND count(*) FILTER (WHERE NOT label) >= 20)"""


@query(FLAGSHIP)
def flagship_detection_report(spark, d):
    """Family-weighted detection report: text features, robust scaling on clean training rows, ranking metrics by language."""
    t = F.col("text")
    labels = table(spark, d, "labels")
    f = table(spark, d, "documents").select("doc_id", "lang", "text").join(labels, "doc_id")
    f = f.select("doc_id", "lang", "toxic", "quality", "text", fn.u01(F.concat(F.lit("f:"), F.col("doc_id").cast("string"))).alias("u"), fn.fingerprint(t).alias("family"))
    chars = f.select("doc_id", F.explode(F.split(t, "")).alias("c")).filter("c <> ''").groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    entropy = chars.groupBy("doc_id").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
    x = f.join(entropy, "doc_id", "left").select(
        "doc_id", "lang", "toxic", "quality", "u", "family", F.log1p(F.length(t)).alias("n_len"), F.log1p(fn.max_line_length(t)).alias("max_line"),
        F.log1p(F.coalesce("entropy", F.lit(0.0))).alias("entropy"), F.log1p(fn.symbol_ratio(t)).alias("symbols"),
    )
    x = checkpointed(x)  # the texts are read once, every quantile and metric reads these rows
    z = robust(x, FEATURES, (F.col("u") < 0.5) & (F.col("quality") == 1) & (F.col("toxic") == 0))
    sizes = z.groupBy("family").agg(F.count("*").alias("size"))
    s = z.join(sizes, "family").select("lang", (F.col("toxic") == 1).alias("label"), F.round(sum(F.abs(c) for c in FEATURES), 6).alias("score"), (1 / F.col("size")).alias("w"))
    s = checkpointed(s)
    g = s.withColumn("lang", F.lit("all")).unionByName(s)
    label = F.col("label")
    enough = g.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(label).alias("positives")).filter("lang = 'all' or (positives >= 5 and n - positives >= 20)")
    a = ranking.auc(g, "score", label, F.col("w"), ["lang"]).select("lang", F.round("auc", 5).alias("auc"))
    c = ranking.caught(g, ranking.thresholds(g, "score", label, [0.1], ["lang"]), "score", label, F.col("w"), ["lang"]).select("lang", F.round("tpr_w", 5).alias("caught10"))
    return enough.join(a, "lang").join(c, "lang")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings), r AS (SELECT * FROM v WHERE id % 5 <> 0), q AS (SELECT * FROM v WHERE id % 5 = 0)"
PAIR_DIST = "list_distance(a.x, b.x)"


@query(f"WITH {VEC}, p AS (SELECT a.id AS q, b.id AS r, {PAIR_DIST} AS dist FROM q a JOIN r b ON a.label = b.label), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS k FROM p) SELECT q, count(*) AS n, round(avg(dist), 6) AS deviation FROM n WHERE k <= 5 GROUP BY 1")
def det_peer_deviation(spark, d):
    v = vectors(spark, d)
    q, r = v.filter("id % 5 = 0"), v.filter("id % 5 <> 0")
    return det.group_deviation(q, r, 5, "label").select("q", "n", F.round("deviation", 6).alias("deviation"))


@query(f"WITH {VEC}, n AS (SELECT a.id AS q, b.id AS r, {PAIR_DIST} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) AS k FROM q a, r b) SELECT q, r, round(dist, 6) AS distance FROM n WHERE k <= 5")
def join_exact_neighbours(spark, d):
    v = vectors(spark, d).select("id", "x", "label")
    return det.neighbours(v.filter("id % 5 = 0"), v.filter("id % 5 <> 0"), 5).select("q", "r", F.round("distance", 6).alias("distance"))


@query(f"""WITH {VEC}, i AS (SELECT * FROM (SELECT a.id AS q, b.id AS r, {PAIR_DIST} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) AS k FROM r a, r b WHERE a.id <> b.id) WHERE k <= 10),
kd AS (SELECT q AS r, max(dist) AS kd FROM i GROUP BY 1), own AS (SELECT q, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM i JOIN kd USING (r) GROUP BY 1),
o AS (SELECT * FROM (SELECT a.id AS q, b.id AS r, {PAIR_DIST} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) AS k FROM q a, r b) WHERE k <= 10),
dens AS (SELECT q, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM o JOIN kd USING (r) GROUP BY 1)
SELECT o.q AS id, round(avg(own.lrd) / any_value(dens.lrd), 6) AS lof FROM o JOIN own ON o.r = own.q JOIN dens ON o.q = dens.q GROUP BY 1""")
def det_lof(spark, d):
    v = vectors(spark, d)
    return det.local_outlier_factor(v.filter("id % 5 = 0"), v.filter("id % 5 <> 0"), 10).select("id", F.round("lof", 6).alias("lof"))


@query()
def det_iforest(spark, d):
    v = vectors(spark, d)
    return det.IsolationForest().fit(v.filter("id % 5 <> 0")).score(v)


@query()
def det_ocsvm(spark, d):
    v = vectors(spark, d)
    return det.OneClassMachine().fit(v.filter("id % 5 <> 0")).score(v)


@query()
def det_trim_refit(spark, d):
    v = vectors(spark, d)
    return det.trim_refit(det.IsolationForest(50), det.IsolationForest(50, seed=1), v.filter("id % 5 <> 0"), 0.05).score(v)


@query()
def det_per_subgroup(spark, d):
    """One machine for each connectivity group, its scores calibrated on its own reference rows and combined."""
    v = vectors(spark, d)
    out = None
    for k in (0, 1):
        own = v.filter(F.col("label") % 2 == k)
        fit = own.filter("id % 5 <> 0")
        m = det.OneClassMachine(seed=k).fit(fit)
        part = ranking.tail_score(m.score(fit).select("score"), m.score(own.filter("id % 5 = 0")), "score").withColumn("grp", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.select("id", "grp", "calibrated")


@query()
def det_supervised_forest(spark, d):
    """Supervised reference: a balanced random forest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors(spark, d).select("id", array_to_vector("x").alias("features"), (F.col("label") < 3).cast("double").alias("y"))
    share = v.agg(F.avg("y")).first()[0] or 0.5
    v = v.withColumn("w", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    model = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=60, seed=7).fit(v.filter("id % 5 <> 0"))
    return model.transform(v).select("id", vector_to_array("probability")[1].alias("score"))


LOSS_ROWS = "b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id < 32)"


@query(f"""WITH {LOSS_ROWS}, s AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.x, b.x) / 0.5 AS s FROM b a, b),
p AS (SELECT i, ln(sum(exp(s)) FILTER (WHERE j <> i)) - max(s) FILTER (WHERE j = CASE WHEN i % 2 = 0 THEN i + 1 ELSE i - 1 END) AS l FROM s GROUP BY 1) SELECT round(avg(l), 6) AS loss FROM p""")
def loss_infonce_value(spark, d):
    """InfoNCE (temperature 0.5) of a fixed batch of 32, rows 2k and 2k + 1 being views of each other."""
    b = vectors(spark, d).filter("id < 32").select("id", "x")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    pairs = b.select(F.col("id").alias("i"), F.col("x").alias("xi")).crossJoin(F.broadcast(b.select(F.col("id").alias("j"), F.col("x").alias("xj"))))  # a batch by itself
    s = pairs.select("i", "j", (dot("xi", "xj") / F.sqrt(dot("xi", "xi") * dot("xj", "xj")) / 0.5).alias("s"))
    view = F.when(F.col("i") % 2 == 0, F.col("i") + 1).otherwise(F.col("i") - 1)
    own = s.groupBy("i").agg((F.log(F.sum(F.when(F.col("i") != F.col("j"), F.exp("s")))) - F.max(F.when(F.col("j") == view, F.col("s")))).alias("l"))
    return own.agg(F.round(F.avg("l"), 6).alias("loss"))


@query(f"""WITH {LOSS_ROWS} SELECT round(avg(greatest(0, list_distance(a.x, p.x) - list_distance(a.x, n.x) + 0.5)), 6) AS loss FROM b a JOIN b p ON p.id = a.id + 1 JOIN b n ON n.id = a.id + 2 WHERE a.id % 3 = 0""")
def loss_triplet_value(spark, d):
    """Triplet loss (margin 0.5) of rows 3k, 3k + 1 (positive) and 3k + 2 (negative)."""
    b = vectors(spark, d).filter("id < 32").select("id", "x")
    dist = lambda p, q: F.sqrt(fn.squared_distance(F.col(p), F.col(q)))
    t = b.filter("id % 3 = 0").select("id", F.col("x").alias("a")).join(b.select((F.col("id") - 1).alias("id"), F.col("x").alias("p")), "id").join(b.select((F.col("id") - 2).alias("id"), F.col("x").alias("n")), "id")
    return t.agg(F.round(F.avg(F.greatest(F.lit(0.0), dist("a", "p") - dist("a", "n") + 0.5)), 6).alias("loss"))


def batch_losses(rows):
    """(batch, infonce) of every batch of 32 consecutive rows(id, x) in the order of ids, as loss_infonce_value has of one.

    Rows without a view (a last odd one) are others' negatives only.
    """
    at = ranking.running_totals(rows.select("id", "x"), "id", {"_n": F.lit(1)}).select("x", (F.col("_n") - 1).alias("k")).withColumn("batch", F.floor(F.col("k") / 32))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    pairs = at.select("batch", F.col("k").alias("i"), F.col("x").alias("xi")).join(at.select("batch", F.col("k").alias("j"), F.col("x").alias("xj")), "batch")  # 32 partners a row
    s = pairs.filter("i <> j").select("batch", "i", "j", (dot("xi", "xj") / F.sqrt(dot("xi", "xi") * dot("xj", "xj")) / 0.5).alias("s"))
    view = F.when(F.col("i") % 2 == 0, F.col("i") + 1).otherwise(F.col("i") - 1)
    own = s.groupBy("batch", "i").agg((F.log(F.sum(F.exp("s"))) - F.max(F.when(F.col("j") == view, F.col("s")))).alias("l"))
    return own.groupBy("batch").agg(F.avg("l").alias("infonce"))


def triplet_losses(rows):
    """(triplet, loss) of rows 3k, 3k + 1 (positive) and 3k + 2 (negative) of all rows(id, x) in the order of ids."""
    at = ranking.running_totals(rows.select("id", "x"), "id", {"_n": F.lit(1)}).select("x", (F.col("_n") - 1).alias("k"))
    role = lambda n: F.max(F.when(F.col("k") % 3 == n, F.col("x")))
    t = at.groupBy(F.floor(F.col("k") / 3).alias("triplet")).agg(role(0).alias("a"), role(1).alias("p"), role(2).alias("n")).filter("n is not null")
    dist = lambda p, q: F.sqrt(fn.squared_distance(F.col(p), F.col(q)))
    return t.select("triplet", F.greatest(F.lit(0.0), dist("a", "p") - dist("a", "n") + 0.5).alias("loss"))


@query()
def loss_infonce_batches(spark, d):
    """The mean InfoNCE loss of all batches (loss_infonce_value has that of the first, which its SQL fixes)."""
    return batch_losses(vectors(spark, d)).agg(F.round(F.avg("infonce"), 6).alias("loss"), F.count("infonce").alias("batches"))


@query()
def loss_triplet_all(spark, d):
    """The mean triplet loss of all rows (loss_triplet_value has that of the first 32)."""
    return triplet_losses(vectors(spark, d)).agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("triplets"))


U = "(('0x' || substr(sha256({}), 1, 15))::BIGINT / 1152921504606846976.0)"


@query(f"""WITH a AS (SELECT l_partkey AS node, list_sort(list(DISTINCT l_orderkey)) AS nb FROM lineitem GROUP BY 1)
SELECT node, slot, nb[1 + floor({U.format("'nb:' || node || ':' || slot")} * len(nb))::BIGINT] AS neighbour FROM a, range(4) t(slot)""")
def sampler_neighbours(spark, d):
    """Four neighbours of each node with replacement."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("nb"))
    a = a.select("node", "nb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("slot"))
    u = fn.u01(F.concat_ws(":", F.lit("nb"), F.col("node").cast("string"), F.col("slot").cast("string")))
    return a.select("node", "slot", F.element_at("nb", (F.floor(u * F.size("nb")) + 1).cast("int")).alias("neighbour"))


@query(f"""WITH m AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1), mode AS (SELECT v AS mode FROM m ORDER BY n DESC, v LIMIT 1), other AS (SELECT list_sort(list(v)) AS o FROM m, mode WHERE v <> mode)
SELECT p_partkey, CASE WHEN p_size = mode THEN o[1 + floor({U.format("'sh:' || p_partkey")} * len(o))::BIGINT] ELSE mode END AS shifted FROM part, mode, other""")
def shift_rare(spark, d):
    """A value at its column's mode becomes an uncommon one, any other the mode."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    counts = p.groupBy("p_size").agg(F.count("*").alias("n"))
    mode = counts.agg(F.max(F.struct("n", (-F.col("p_size")).alias("v"))).alias("m")).select((-F.col("m.v")).alias("mode"))
    other = counts.crossJoin(mode).filter("p_size <> mode").groupBy("mode").agg(F.array_sort(F.collect_set("p_size")).alias("o"))  # distinct values of a column of small range
    u = fn.u01(F.concat(F.lit("sh:"), F.col("p_partkey").cast("string")))
    return p.crossJoin(F.broadcast(other)).select("p_partkey", F.when(F.col("p_size") == F.col("mode"), F.element_at("o", (F.floor(u * F.size("o")) + 1).cast("int"))).otherwise(F.col("mode")).alias("shifted"))


@query(f"SELECT vec_id, len(list_filter(range(64), lambda i: {U.format('''vec_id || ':' || i''')} < 0.2)) AS masked FROM embeddings")
def view_feature_mask(spark, d):
    """A view of a vector: positions masked by a hash draw of 0.2."""
    v = table(spark, d, "embeddings").select("vec_id")
    i = v.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    u = fn.u01(F.concat_ws(":", F.col("vec_id").cast("string"), F.col("i").cast("string")))
    return i.withColumn("m", (u < 0.2).cast("int")).groupBy("vec_id").agg(F.sum("m").alias("masked"))


@query(f"WITH {VEC}, c AS (SELECT id, (id * 7 + k) % (SELECT count(*) FROM v) AS donor FROM q, range(5) t(k)), j AS (SELECT a.id, b.id AS donor, {PAIR_DIST} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY dist DESC, b.id) AS k FROM c JOIN v a USING (id) JOIN v b ON c.donor = b.id) SELECT id, donor FROM j WHERE k = 1")
def inject_anomaly_donor(spark, d):
    """The farthest of a few candidate donors, whose features an injected anomaly takes."""
    v = vectors(spark, d)
    n = v.count()
    c = v.filter("id % 5 = 0").select("id", F.col("x").alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("k")).withColumn("donor", (F.col("id") * 7 + F.col("k")) % n)
    j = c.join(v.select(F.col("id").alias("donor"), "x"), "donor").select("id", "donor", fn.squared_distance(F.col("own"), F.col("x")).alias("d"))
    return j.groupBy("id").agg(F.min(F.struct((-F.col("d")).alias("d"), "donor")).alias("m")).select("id", "m.donor")


@query()
def encoder_gin_svdd(spark, d):
    """One sampled graph layer over the exact-neighbour graph of the vectors, scored by distance to the training centre."""
    from driftwood.operators import encoders as enc

    v = vectors(spark, d).select("id", "x", "label")
    n = checkpointed(det.neighbours(v, v.filter("id % 5 <> 0"), 5)).groupBy(F.col("q").alias("node")).agg(F.array_sort(F.collect_list("r")).alias("nb"))
    h = checkpointed(enc.gin_layer(v.select("id", "x"), enc.sampled(n, 8, "gin"), enc.weights(64, 16, 3), 64))
    return enc.svdd_scores(h, h.filter("id % 5 <> 0"))


@query()
def source_requirement_names(spark, d):
    """Metadata headers built from parts, parsed as an archive's are."""
    import pandas as pd

    from driftwood.sources.archives import declared, metadata

    head = F.concat_ws("\n", F.concat(F.lit("Name: "), "p_name"), F.concat(F.lit("Home-page: https://github.com/"), F.lower("p_brand")), F.concat(F.lit("Author: "), "p_brand"), F.concat(F.lit("Requires-Dist: "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" (>=1)")), F.lit("License: MIT"), F.lit(""), F.col("p_type"))

    def run(batches):
        for b in batches:
            rows = []
            for key, text in zip(b.p_partkey, b["head"], strict=True):
                m, (deps, status) = metadata(text), declared({"x/PKG-INFO": text})
                rows.append((key, deps[0][0] if deps else None, status, m["link_count"], m["has_source_repo"], m["description_length"], m["author_repo_consistency"]))
            yield pd.DataFrame(rows, columns=["p_partkey", "dep", "status", "link_count", "has_source_repo", "description_length", "author_repo_consistency"])

    return table(spark, d, "part").select("p_partkey", head.alias("head")).mapInPandas(run, "p_partkey long, dep string, status string, link_count int, has_source_repo int, description_length int, author_repo_consistency int")
