"""Graph tables, peer joins and composites.  Releases are orders, dependencies their parts, families their customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.operators import graph as g, ranking, relational as rel
from driftwood.plans.registry import query
from driftwood.plans.relational import SPLIT, order_splits
from driftwood.sources.tables import table

DEPS = "deps AS (SELECT DISTINCT l_orderkey AS name, l_partkey AS dep FROM lineitem WHERE l_orderkey <> l_partkey)"
GRAPH = f"""s AS ({SPLIT}), {DEPS}, own AS (SELECT o_orderkey AS name, row_number() OVER (ORDER BY o_orderkey) - 1 AS node FROM s WHERE split = 'train'),
d AS (SELECT deps.* FROM deps JOIN own USING (name)), ctx AS (SELECT dep AS name, (SELECT count(*) FROM own) + row_number() OVER (ORDER BY dep) - 1 AS node FROM (SELECT DISTINCT dep FROM d WHERE dep NOT IN (SELECT name FROM own))),
nodes AS (SELECT *, false AS is_context FROM own UNION ALL SELECT *, true FROM ctx), edges AS (SELECT a.node AS src, b.node AS dst FROM d JOIN nodes a ON a.name = d.name JOIN nodes b ON b.name = d.dep)"""


def deps(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_partkey").alias("dep")).filter("name <> dep").distinct()


def train_graph(spark, d):
    return g.build(order_splits(spark, d).filter("split = 'train'").select(F.col("o_orderkey").alias("name")), deps(spark, d))


@query(f"WITH {GRAPH} SELECT name, node, is_context FROM nodes")
def graph_build_nodes(spark, d):
    return train_graph(spark, d)[0].select("name", "node", "is_context")


@query(f"WITH {GRAPH} SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
def graph_build_edges(spark, d):
    return g.undirected(train_graph(spark, d)[1])


@query(f"WITH {GRAPH} SELECT node, (SELECT count(*) FROM edges WHERE src = node) AS out_deg, (SELECT count(*) FROM edges WHERE dst = node) AS in_deg FROM nodes")
def graph_degrees(spark, d):
    nodes, edges = train_graph(spark, d)
    return g.degrees(nodes.select("node"), edges)


TOKENS = f"s AS ({SPLIT}), {DEPS}, tok AS (SELECT o_orderkey AS id, o_orderkey AS token FROM orders UNION SELECT name, dep FROM deps), q AS (SELECT tok.* FROM tok JOIN s ON id = o_orderkey WHERE split = 'test'), r AS (SELECT tok.* FROM tok JOIN s ON id = o_orderkey WHERE split = 'train')"
PAIRS = f"{TOKENS}, pairs AS (SELECT q.id AS q, r.id AS r, count(*) AS shared FROM q JOIN r USING (token) GROUP BY ALL)"


def tokens(spark, d):
    """Each release's set: its own name and its dependencies; queries are test releases, references train releases."""
    tok = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("token")).union(deps(spark, d))
    s = order_splits(spark, d).select(F.col("o_orderkey").alias("id"), "split")
    tok = tok.join(s, "id")
    return tok.filter("split = 'test'").select("id", "token"), tok.filter("split = 'train'").select("id", "token")


@query(f"WITH {PAIRS} SELECT q, r, shared FROM pairs")
def join_peer_overlap(spark, d):
    return g.peer_pairs(*tokens(spark, d))


@query(f"WITH {PAIRS} SELECT q AS id, count(*) FILTER (WHERE q <> r) AS n_peers FROM pairs GROUP BY 1")
def join_peer_count(spark, d):
    return g.peer_pairs(*tokens(spark, d)).groupBy(F.col("q").alias("id")).agg(F.count_if(F.col("q") != F.col("r")).alias("n_peers"))


@query(f"""WITH {PAIRS} SELECT o_orderkey AS id, (SELECT count(*) FROM deps WHERE name = o_orderkey) AS out_deg, (SELECT count(*) FROM deps WHERE dep = o_orderkey) AS in_deg,
(SELECT count(*) FROM deps WHERE name = o_orderkey OR dep = o_orderkey) > 0 AS connected, o_orderkey IN (SELECT q FROM pairs WHERE q <> r) AS has_peers FROM s WHERE split = 'test'""")
def graph_connectivity(spark, d):
    q, r = tokens(spark, d)
    e = deps(spark, d)
    ids = order_splits(spark, d).filter("split = 'test'").select(F.col("o_orderkey").alias("node"))
    deg = g.degrees(ids, e.select(F.col("name").alias("src"), F.col("dep").alias("dst"))).withColumnRenamed("node", "id")
    peers = g.has_peers(q, r).withColumn("has_peers", F.lit(True))
    return deg.join(peers, "id", "left").select("id", "out_deg", "in_deg", (F.col("out_deg") + F.col("in_deg") > 0).alias("connected"), F.coalesce("has_peers", F.lit(False)).alias("has_peers"))


@query(f"WITH {PAIRS} SELECT DISTINCT q AS id FROM pairs WHERE q <> r")
def subgroup_has_peers(spark, d):
    return g.has_peers(*tokens(spark, d))


@query(f"WITH s AS ({SPLIT}), {DEPS} SELECT split, avg((o_orderkey NOT IN (SELECT name FROM deps) AND o_orderkey NOT IN (SELECT dep FROM deps))::INT) AS isolated FROM s GROUP BY 1")
def graph_isolated_share(spark, d):
    e = deps(spark, d)
    linked = e.select(F.col("name").alias("o_orderkey")).union(e.select("dep")).distinct().withColumn("l", F.lit(1))
    return order_splits(spark, d).join(linked, "o_orderkey", "left").groupBy("split").agg(F.avg(F.col("l").isNull().cast("int")).alias("isolated"))


@query(f"""WITH {GRAPH}, h AS (SELECT o_orderkey AS name FROM s WHERE split = 'test') SELECT h.name AS held, 'out' AS side, nodes.node, deps.dep AS other FROM h JOIN deps ON deps.name = h.name LEFT JOIN nodes ON nodes.name = deps.dep
UNION ALL SELECT h.name, 'in', own.node, own.name FROM h JOIN deps ON deps.dep = h.name JOIN own ON own.name = deps.name""")
def graph_insert_heldout(spark, d):
    """Links of every held-out release to the training graph: its dependencies (node null: a new context node) and its dependents."""
    nodes, _ = train_graph(spark, d)
    e, held = deps(spark, d), order_splits(spark, d).filter("split = 'test'").select(F.col("o_orderkey").alias("held"))
    out = e.join(held, F.col("name") == F.col("held")).join(nodes.select(F.col("name").alias("dep"), "node"), "dep", "left").select("held", F.lit("out").alias("side"), "node", F.col("dep").alias("other"))
    into = e.join(held, F.col("dep") == F.col("held")).join(nodes.filter("not is_context").select("name", "node"), "name").select("held", F.lit("in").alias("side"), "node", F.col("name").alias("other"))
    return out.unionByName(into)


@query(f"WITH {DEPS} SELECT dep AS dst, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM deps JOIN orders ON name = o_orderkey GROUP BY 1 HAVING count(*) >= 3")
def graph_user_profile_mean(spark, d):
    e = deps(spark, d).select(F.col("name").alias("src"), F.col("dep").alias("dst"))
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), "o_totalprice")
    return g.profile_means(e, x, "o_totalprice").select("dst", "n", F.round("mean", 4).alias("mean"))


@query(f"WITH {DEPS}, x AS (SELECT name AS src, dep AS dst, round(o_totalprice * 100)::BIGINT AS v FROM deps JOIN orders ON name = o_orderkey) SELECT src, dst, (CASE WHEN count(*) OVER w > 1 THEN (sum(v) OVER w - v)::DOUBLE / (count(*) OVER w - 1) ELSE 0 END)::DOUBLE AS others FROM x WINDOW w AS (PARTITION BY dst)")
def graph_leave_one_out(spark, d):
    e = deps(spark, d).select(F.col("name").alias("src"), F.col("dep").alias("dst"))
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return g.leave_one_out(e, x, "cents")


@query(f"WITH {DEPS}, k AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0) SELECT name, dep FROM deps WHERE name IN (FROM k) AND (dep IN (FROM k) OR dep NOT IN (SELECT o_orderkey FROM orders))")
def graph_subsample(spark, d):
    """The edges left when a quarter of the releases goes: none that touches one of these."""
    gone = table(spark, d, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"))
    kept = deps(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("name")), "name", "left_semi")
    return kept.join(gone.withColumnRenamed("id", "name"), "name", "left_anti").join(gone.withColumnRenamed("id", "dep"), "dep", "left_anti").select("name", "dep")


@query(f"WITH {DEPS} SELECT dep AS node, list_sort(list(name)) AS users FROM deps GROUP BY 1")
def graph_adjacency(spark, d):
    return deps(spark, d).groupBy(F.col("dep").alias("node")).agg(F.array_sort(F.collect_list("name")).alias("users"))


@query(f"WITH {DEPS}, f AS (SELECT name, min(o_orderkey) AS first_release FROM (SELECT o_custkey AS name, o_orderkey FROM orders) GROUP BY 1) SELECT deps.name, dep, coalesce(first_release, -dep) AS target FROM deps LEFT JOIN f ON f.name = dep")
def join_target_resolution(spark, d):
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("dep")).agg(F.min("o_orderkey").alias("first_release"))
    return deps(spark, d).join(first, "dep", "left").select("name", "dep", F.coalesce("first_release", -F.col("dep")).alias("target"))


@query(f"WITH {PAIRS}, nq AS (SELECT id, count(*) AS n FROM q GROUP BY 1), nr AS (SELECT id, count(*) AS n FROM r GROUP BY 1) SELECT q, round(max(shared / (nq.n + nr.n - shared)), 9) AS max_jaccard FROM pairs JOIN nq ON q = nq.id JOIN nr ON r = nr.id GROUP BY 1")
def join_max_jaccard(spark, d):
    q, r = tokens(spark, d)
    return g.max_jaccard(q, r).select("q", F.round("max_jaccard", 9).alias("max_jaccard"))


ONLY_DEPS = f"s AS ({SPLIT}), {DEPS}, q AS (SELECT name AS id, dep AS token FROM deps JOIN s ON name = o_orderkey WHERE split = 'test'), r AS (SELECT name AS id, dep AS token FROM deps JOIN s ON name = o_orderkey WHERE split = 'train')"


def dep_tokens(spark, d):
    s = order_splits(spark, d).select(F.col("o_orderkey").alias("name"), "split")
    tok = deps(spark, d).join(s, "name").select(F.col("name").alias("id"), F.col("dep").alias("token"), "split")
    return tok.filter("split = 'test'").drop("split"), tok.filter("split = 'train'").drop("split")


@query(f"WITH {ONLY_DEPS}, p AS (SELECT q.id AS q, r.id AS r, count(*) AS shared FROM q JOIN r USING (token) GROUP BY ALL), n AS (SELECT id, count(*) AS n FROM q GROUP BY 1) SELECT id AS q, count(r) AS support FROM n LEFT JOIN p ON q = id AND shared = n GROUP BY 1")
def join_containment_support(spark, d):
    q, r = dep_tokens(spark, d)
    return g.containment_support(q, r)


@query(f"""WITH {ONLY_DEPS}, dq AS (SELECT a.id, a.token AS a, b.token AS b FROM q a JOIN q b ON a.id = b.id AND a.token < b.token), dr AS (SELECT DISTINCT a.token AS a, b.token AS b FROM r a JOIN r b ON a.id = b.id AND a.token < b.token)
SELECT id, count(*) AS unseen FROM dq ANTI JOIN dr USING (a, b) GROUP BY 1""")
def join_unseen_pairs(spark, d):
    """Pairs of dependencies that no training release has together (a release has at most a few)."""
    q, r = dep_tokens(spark, d)

    def pairs(tok):
        sets = tok.groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("s"))
        return sets.select("id", F.posexplode("s").alias("k", "a"), "s").select("id", "a", F.explode(F.slice("s", F.col("k") + 2, F.size("s"))).alias("b"))

    return pairs(q).join(pairs(r).select("a", "b").distinct(), ["a", "b"], "left_anti").groupBy("id").agg(F.count("*").alias("unseen"))


@query(f"WITH {ONLY_DEPS}, use AS (SELECT token, count(*) AS n FROM r GROUP BY 1) SELECT q.id, count(*) FILTER (WHERE use.n IS NULL) AS n_unknown, min(coalesce(use.n, 0)) AS rarest FROM q LEFT JOIN use USING (token) GROUP BY 1")
def join_rarest_dependency(spark, d):
    q, r = dep_tokens(spark, d)
    use = r.groupBy("token").agg(F.count("*").alias("n"))
    return q.join(use, "token", "left").groupBy("id").agg(F.count_if(F.col("n").isNull()).alias("n_unknown"), F.min(F.coalesce("n", F.lit(0))).alias("rarest"))


@query("""WITH t AS (SELECT o_custkey, o_orderdate::DATE AS artefact FROM orders GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY artefact) AS n FROM t)
SELECT o_custkey, count(*) FILTER (WHERE n BETWEEN 2 AND 8) > 0 AS has_twin, count(*) FILTER (WHERE n > 8) AS too_common FROM c GROUP BY 1""")
def join_artifact_twins(spark, d):
    """Families that share an artefact (a day) with others; artefacts of more than eight families are too common to tell."""
    t = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("artefact")).distinct()
    n = t.groupBy("artefact").agg(F.count("*").alias("n"))
    return t.join(n, "artefact").groupBy("o_custkey").agg((F.count_if(F.col("n").between(2, 8)) > 0).alias("has_twin"), F.count_if(F.col("n") > 8).alias("too_common"))


@query(f"WITH {DEPS}, e AS (SELECT a.o_orderkey AS id, a.o_totalprice AS s FROM orders a), p AS (SELECT name AS a, dep AS b FROM deps WHERE dep IN (SELECT o_orderkey FROM orders)), both_ AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), m AS (SELECT a, max(s) AS near FROM both_ JOIN e ON b = id GROUP BY 1) SELECT id, greatest(s, coalesce(near, s)) AS score FROM e LEFT JOIN m ON a = id")
def graph_propagate_max(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    pairs = deps(spark, d).join(o.select(F.col("id").alias("dep")), "dep", "left_semi").select(F.col("name").alias("a"), F.col("dep").alias("b"))
    return g.propagate_max(o, pairs)


FLAGS = """f AS (SELECT o_orderkey AS id, o_custkey AS family, o_orderpriority AS grp, EXISTS (SELECT 1 FROM deps WHERE dep = o_orderkey) AS used, NOT EXISTS (SELECT 1 FROM deps WHERE name = o_orderkey) AND NOT EXISTS (SELECT 1 FROM deps WHERE dep = o_orderkey) AS isolated,
EXISTS (SELECT 1 FROM deps JOIN orders x ON dep = x.o_orderkey WHERE name = orders.o_orderkey) AS chain FROM orders)"""


def flags(spark, d):
    e, o = deps(spark, d), table(spark, d, "orders")
    mark = lambda ids, name: ids.distinct().withColumn(name, F.lit(True))
    named, used = mark(e.select(F.col("name").alias("id")), "names"), mark(e.select(F.col("dep").alias("id")), "used")
    chain = mark(e.join(o.select(F.col("o_orderkey").alias("dep")), "dep", "left_semi").select(F.col("name").alias("id")), "chain")
    out = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("family"), F.col("o_orderpriority").alias("grp"))
    for m in (named, used, chain):
        out = out.join(m, "id", "left")
    out = out.na.fill(False)
    return out.select("id", "family", "grp", "used", (~F.col("names") & ~F.col("used")).alias("isolated"), "chain")


@query(f"WITH {DEPS}, {FLAGS} SELECT * FROM f")
def relation_flags(spark, d):
    return flags(spark, d)


@query(f"""WITH {DEPS}, {FLAGS}, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY grp, family) AS w FROM f)
SELECT grp, count(*) AS n, avg(used::INT) AS used, avg(chain::INT) AS chain, sum(w * used::INT) / sum(w) AS used_fw, sum(w * chain::INT) / sum(w) AS chain_fw FROM w GROUP BY 1""")
def relation_group_profile(spark, d):
    f = flags(spark, d)
    f = f.join(f.groupBy("grp", "family").agg(F.count("*").alias("size")), ["grp", "family"]).withColumns({"u": F.col("used").cast("int"), "c": F.col("chain").cast("int"), "w": 1 / F.col("size")})
    fw = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    return f.groupBy("grp").agg(F.count("*").alias("n"), F.avg("u").alias("used"), F.avg("c").alias("chain"), fw("u").alias("used_fw"), fw("c").alias("chain_fw"))


@query(f"""WITH {DEPS}, {FLAGS}, m AS (SELECT f.*, o_orderstatus = 'F' AS label, o_totalprice > 150000 AS caught FROM f JOIN orders ON id = o_orderkey),
u AS (SELECT label, caught, unnest(['used', 'isolated', 'chain']) AS flag, unnest([used, isolated, chain]) AS v FROM m)
SELECT flag, avg(v::INT) FILTER (WHERE label AND NOT caught) AS gain, avg(v::INT) FILTER (WHERE NOT label) AS alarms FROM u GROUP BY 1""")
def relation_ceiling(spark, d):
    """What a flag would add: share of missed positives that have it, against the share of negatives."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("label"), (F.col("o_totalprice") > 150000).alias("caught"))
    u = rel.unpivot(flags(spark, d).join(o, "id"), ["label", "caught"], ["used", "isolated", "chain"], "flag", "v")
    return u.groupBy("flag").agg(F.avg(F.when(F.col("label") & ~F.col("caught"), F.col("v"))).alias("gain"), F.avg(F.when(~F.col("label"), F.col("v"))).alias("alarms"))


@query(f"""WITH {DEPS}, g AS (SELECT o_orderkey AS id, o_totalprice AS score, o_orderstatus = 'F' AS label, count(dep) AS deg FROM orders LEFT JOIN deps ON name = o_orderkey GROUP BY ALL),
r AS (SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER () AS pct FROM g)
SELECT CASE WHEN deg <= 0 THEN '0' WHEN deg <= 1 THEN '1' WHEN deg <= 3 THEN '2-3' WHEN deg <= 9 THEN '4-9' ELSE '10+' END AS bucket, label, count(*) AS n, round(avg(pct), 6) AS mean_pct FROM r GROUP BY ALL""")
def degree_diagnosis(spark, d):
    n = deps(spark, d).groupBy(F.col("name").alias("id")).agg(F.count("*").alias("deg"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("label"))
    r = ranking.midrank(o.join(n, "id", "left").na.fill(0, ["deg"]), "score")
    k = F.col("deg")
    bucket = F.when(k <= 0, "0").when(k <= 1, "1").when(k <= 3, "2-3").when(k <= 9, "4-9").otherwise("10+")
    return r.groupBy(bucket.alias("bucket"), "label").agg(F.count("*").alias("n"), F.round(F.avg("pct"), 6).alias("mean_pct"))


@query(f"""WITH {GRAPH}, h AS (SELECT o_orderkey FROM s WHERE split <> 'train')
SELECT (SELECT count(*) FROM own JOIN h ON name = o_orderkey) AS heldout_in_graph, (SELECT count(*) FROM edges WHERE src = dst) AS self_links, (SELECT count(*) FROM (SELECT node FROM nodes GROUP BY 1 HAVING count(*) > 1)) AS repeated_nodes,
(SELECT count(*) FROM s ANTI JOIN orders USING (o_orderkey)) AS unknown_releases, (SELECT count(*) FROM edges WHERE src >= (SELECT count(*) FROM own)) AS context_with_deps""")
def bundle_checks(spark, d):
    """Figures that must be 0 in a valid bundle."""
    nodes, edges = train_graph(spark, d)
    own, s = nodes.filter("not is_context"), order_splits(spark, d)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    checks = [
        count(own.join(s.filter("split <> 'train'").select(F.col("o_orderkey").alias("name")), "name", "left_semi"), "heldout_in_graph"), count(edges.filter("src = dst"), "self_links"),
        count(nodes.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1"), "repeated_nodes"), count(rel.unmatched(s, table(spark, d, "orders"), ["o_orderkey"]), "unknown_releases"),
        count(edges.join(nodes.filter("is_context").select(F.col("node").alias("src")), "src", "left_semi"), "context_with_deps"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.crossJoin(c)  # of one row each
    return out
