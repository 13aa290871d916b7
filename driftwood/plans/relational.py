"""Relational queries: splits, joins, aggregates, windows, set operators and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwood.functions.scalars import clean_unknown, clip, contamination_size, is_close, right_closed, split_of, u01
from driftwood.operators import relational as rel
from driftwood.operators.selection import percentiles
from driftwood.plans.registry import query
from driftwood.sources.tables import table


def sql_u01(key: str) -> str:
    return f"(('0x' || substr(sha256({key}), 1, 15))::BIGINT / 1152921504606846976.0)"


SPLIT = f"""SELECT o_orderkey, o_custkey, {sql_u01("'s:' || o_orderkey")} AS u,
  CASE WHEN u < 0.5 THEN 'train' WHEN u < 0.7 THEN 'val' ELSE 'test' END AS split FROM orders"""


def order_splits(spark, d, salt="s"):
    u = u01(F.concat(F.lit(f"{salt}:"), F.col("o_orderkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", u.alias("u")).withColumn("split", split_of(F.col("u")))


@query(SPLIT)
def split_hash_bucket(spark, d):
    return order_splits(spark, d)


@query(f"""WITH r AS (SELECT o_orderkey, o_custkey, {sql_u01("'cap:' || o_orderkey")} AS u,
  row_number() OVER (PARTITION BY o_custkey ORDER BY u, o_orderkey) AS n FROM orders)
SELECT o_orderkey, o_custkey, u, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey) AS family_weight FROM r WHERE n <= 10""")
def split_family_capped(spark, d):
    return rel.capped_groups(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 10, "cap")


@query(f"""WITH s AS ({SPLIT}), old AS (SELECT * FROM s WHERE o_orderkey % 3 <> 0)
SELECT s.split, count(*) AS n, count(old.split) AS known, count(*) FILTER (WHERE old.split <> s.split) AS changed
FROM s LEFT JOIN old USING (o_orderkey) GROUP BY 1""")
def split_stability(spark, d):
    new = order_splits(spark, d)
    old = new.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.col("split").alias("before"))
    return new.join(old, "o_orderkey", "left").groupBy("split").agg(F.count("*").alias("n"), F.count("before").alias("known"), F.count_if(F.col("before") != F.col("split")).alias("changed"))


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def join_left_chain(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    out = rel.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], ["c_name"])
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return out.join(n, "c_nationkey", "left").join(r, "n_regionkey", "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def join_inner(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, d, "lineitem").filter("l_quantity > 45").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderdate")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def join_semi(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def join_anti_resume(spark, d):
    done = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return rel.resume(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("""SELECT (SELECT count(*) FROM lineitem l ANTI JOIN orders o ON l_orderkey = o_orderkey) AS lines_without_order,
(SELECT count(*) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey) AS orders_without_line""")
def join_missing_check(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    a = rel.unmatched(li, o, ["o_orderkey"]).agg(F.count("*").alias("lines_without_order"))
    return a.crossJoin(rel.unmatched(o, li, ["o_orderkey"]).agg(F.count("*").alias("orders_without_line")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n = 1")
def join_keep_last(spark, d):
    return rel.keep_first(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT p_partkey, s_name FROM part LEFT JOIN (SELECT l_partkey, max(l_suppkey) AS s FROM lineitem GROUP BY 1) ON p_partkey = l_partkey
LEFT JOIN supplier ON s = s_suppkey""")
def join_map_lookup(spark, d):
    last = rel.keep_first(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")), ["p_partkey"], [F.desc("s_suppkey")])
    return table(spark, d, "part").select("p_partkey").join(last, "p_partkey", "left").join(table(spark, d, "supplier"), "s_suppkey", "left").select("p_partkey", "s_name")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mean_qty, coalesce(stddev_samp(l_extendedprice), 0) AS sd_price,
min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL""")
def agg_named_multi(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.avg("l_quantity").alias("mean_qty"), F.coalesce(F.stddev_samp("l_extendedprice"), F.lit(0.0)).alias("sd_price"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.countDistinct("l_suppkey").alias("suppliers"),
    )


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, list_sort(list(DISTINCT o_orderstatus)) AS statuses FROM orders GROUP BY 1")
def agg_set_concat(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ";").alias("priorities"), F.sort_array(F.collect_set("o_orderstatus")).alias("statuses"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube_margins(spark, d):
    return rel.cube_counts(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS O,
round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY 1""")
def agg_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("""WITH w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_suppkey) AS w FROM lineitem)
SELECT l_returnflag, sum(w * l_discount) / sum(w) AS mean_w FROM w GROUP BY 1""")
def agg_weighted_mean(spark, d):
    li = table(spark, d, "lineitem")
    sizes = li.groupBy("l_suppkey").agg(F.count("*").alias("size"))
    return li.join(sizes, "l_suppkey").groupBy("l_returnflag").agg((F.sum(F.col("l_discount") / F.col("size")) / F.sum(1 / F.col("size"))).alias("mean_w"))


SEEDS = f"""(SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, seed, {sql_u01("seed || ':' || o_orderkey")} AS score FROM orders, range(3) t(seed))"""


def seeded_scores(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.explode(F.array(*(F.lit(s).cast("bigint") for s in range(3)))).alias("seed"))
    return o.withColumn("score", u01(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("o_orderkey").cast("string"))))


@query(f"""WITH m AS (SELECT o_orderpriority, seed, avg(score) AS s FROM {SEEDS} GROUP BY ALL)
SELECT o_orderpriority, avg(s) AS mean, coalesce(stddev_samp(s), 0) AS sd, min(s) AS lo, max(s) AS hi, count(*) AS seeds FROM m GROUP BY 1""")
def agg_seed_stats(spark, d):
    m = seeded_scores(spark, d).groupBy("o_orderpriority", "seed").agg(F.avg("score").alias("s"))
    return m.groupBy("o_orderpriority").agg(F.avg("s").alias("mean"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("sd"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("seeds"))


@query("SELECT o_custkey, max(o_totalprice) AS price, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def agg_argmax_row(spark, d):
    return rel.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", F.col("o_totalprice").alias("price"), "o_orderkey")


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.99) AS q99, median(l_extendedprice) AS mid, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem GROUP BY 1")
def agg_quantile_linear(spark, d):
    q = percentiles(table(spark, d, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.75, 0.99], ["l_returnflag"])
    return q.select("l_returnflag", F.col("q")[3].alias("q99"), F.col("q")[1].alias("mid"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


@query("""WITH long AS (UNPIVOT (SELECT p_size::DOUBLE AS p_size, p_retailprice::DOUBLE AS p_retailprice FROM part) ON p_size, p_retailprice INTO NAME feature VALUE value),
c AS (SELECT feature, round(value, 6) AS v, count(*) AS n FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY feature) AS total FROM c)
SELECT feature, v AS mode, 1 - n / total AS variability FROM r WHERE k = 1""")
def agg_mode_variability(spark, d):
    return rel.variability(rel.unpivot(table(spark, d, "part"), [], ["p_size", "p_retailprice"]))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL),
p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def agg_char_entropy(spark, d):
    chars = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''")
    n = chars.groupBy("doc_id", "ch").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return n.select("doc_id", F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def agg_counter_split(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS f FROM orders GROUP BY 1)
SELECT median(n)::DOUBLE AS mid_size, avg(f) AS mean_share, count(*) AS families FROM c""")
def agg_median_share(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    return c.agg(F.median("n").alias("mid_size"), F.avg("f").alias("mean_share"), F.count("*").alias("families"))


@query("SELECT event_id, user_id, rank() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS release_rank, ts = min(ts) OVER (PARTITION BY user_id) AS is_first FROM events")
def win_release_rank(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, d, "events").select("event_id", "user_id", (F.rank().over(w) - 1).cast("bigint").alias("release_rank"), (F.col("ts") == F.min("ts").over(Window.partitionBy("user_id"))).alias("is_first"))


@query("""SELECT event_id, date_diff('day', ts::DATE, (max(ts) OVER (PARTITION BY user_id))::DATE) AS days_to_latest, ts = max(ts) OVER (PARTITION BY user_id) AS is_latest,
(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 86400000000.0 AS project_age_days, year(ts) AS year FROM events""")
def win_recency(spark, d):
    w = Window.partitionBy("user_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, d, "events").select(
        "event_id", F.datediff(F.max("ts").over(w), "ts").cast("bigint").alias("days_to_latest"), (F.col("ts") == F.max("ts").over(w)).alias("is_latest"),
        ((micros(F.col("ts")) - micros(F.min("ts").over(w))) / 86400e6).alias("project_age_days"), F.year("ts").cast("bigint").alias("year"),
    )


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def win_topn(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL")
def win_dedupe(spark, d):
    return rel.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], ["l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, count(*) OVER w AS size, min(o_orderkey) OVER w AS first_key, max(o_orderkey) OVER w AS last_key FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def win_group_transform(spark, d):
    o = table(spark, d, "orders")
    return o.join(o.groupBy("o_custkey").agg(F.count("*").alias("size"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")), "o_custkey").select("o_orderkey", "size", "first_key", "last_key")


@query("""WITH r AS (SELECT max(ts) AS ref FROM events), a AS (SELECT user_id, CASE WHEN user_id % 4 <> 0 THEN date_diff('day', max(ts)::DATE, any_value(ref)::DATE) END AS age FROM events, r GROUP BY 1)
SELECT user_id, coalesce(age, avg(age) OVER ())::DOUBLE AS age FROM a""")
def win_mean_imputed_age(spark, d):
    e = table(spark, d, "events")
    a = e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(e.agg(F.max("ts").alias("ref")))
    a = a.select("user_id", F.when(F.col("user_id") % 4 != 0, F.datediff("ref", "last")).alias("age"))
    return a.crossJoin(a.agg(F.avg("age").alias("mean"))).select("user_id", F.coalesce(F.col("age").cast("double"), "mean").alias("age"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity <= 0 THEN NULL WHEN l_quantity <= 1 THEN '1' WHEN l_quantity <= 5 THEN '2-5' WHEN l_quantity <= 20 THEN '6-20' WHEN l_quantity <= 100 THEN '21-100' ELSE NULL END AS bucket FROM lineitem")
def bucket_right_closed(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", right_closed(F.col("l_quantity"), [0, 1, 5, 20, 100], ["1", "2-5", "6-20", "21-100"]).alias("bucket"))


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05")
def filter_isclose(spark, d):
    return table(spark, d, "lineitem").filter(is_close(F.col("l_discount"), 0.05)).select("l_orderkey", "l_linenumber", "l_discount")


@query("""SELECT l_orderkey, l_linenumber, greatest(l_discount > 0.08, l_tax > 0.06) AS flagged, least(l_quantity, 40.0)::DOUBLE AS clipped,
CASE l_returnflag WHEN 'R' THEN 'malicious' ELSE 'normal' END AS role FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 10""")
def filter_flag_recode(spark, d):
    li = table(spark, d, "lineitem").filter("l_linestatus = 'F' and l_quantity > 10")
    return li.select("l_orderkey", "l_linenumber", F.greatest(F.col("l_discount") > 0.08, F.col("l_tax") > 0.06).alias("flagged"), clip(F.col("l_quantity"), high=40.0).cast("double").alias("clipped"), F.when(F.col("l_returnflag") == "R", "malicious").otherwise("normal").alias("role"))


@query("""SELECT p_partkey, p_name LIKE '%' || lower(p_name[1:2]) || '%' AS has_prefix, regexp_matches(p_type, '[A-Z]{2}') AS upper_type,
CASE WHEN lower(trim(p_brand)) IN ('unknown', 'none', '') THEN '' ELSE trim(p_brand) END AS brand FROM part""")
def filter_contains(spark, d):
    return table(spark, d, "part").select("p_partkey", F.contains("p_name", F.lower(F.substring("p_name", 1, 2))).alias("has_prefix"), F.col("p_type").rlike("[A-Z]{2}").alias("upper_type"), clean_unknown(F.col("p_brand")).alias("brand"))


@query("""WITH f AS (SELECT event_id, event_type = 'error' OR event_id % 7 = 0 AS failed, (props->>'k')::INT AS k, value FROM events)
SELECT event_id, failed, CASE WHEN failed THEN 3.0 ELSE coalesce(value, 3.0) END AS min_dist, CASE WHEN failed THEN 0 ELSE coalesce(k, 0) END AS k, NOT failed AND coalesce(k, 0) > 50 AS gd_flagged FROM f""")
def flag_rollup_json(spark, d):
    props = F.from_json("props", "k int")
    e = table(spark, d, "events").select("event_id", ((F.col("event_type") == "error") | (F.col("event_id") % 7 == 0)).alias("failed"), props["k"].alias("k"), F.col("value").alias("min_dist"))
    e = rel.repair_failed(e, F.col("failed"), ["k", "min_dist"], {"min_dist": 3.0})
    return e.withColumn("gd_flagged", F.col("k") > 50)


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount, NULL::VARCHAR AS name FROM orders
UNION ALL SELECT 'customer', c_custkey, NULL, c_name FROM customer""")
def set_union_by_name(spark, d):
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return rel.union_all(o, c)


@query("SELECT l_partkey AS k FROM lineitem UNION SELECT o_orderkey FROM orders")
def set_union_distinct(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).union(table(spark, d, "orders").select("o_orderkey")).distinct()


@query(f"""WITH s AS ({SPLIT}), v AS (SELECT o_custkey FROM s WHERE split = 'val'), t AS (SELECT o_custkey FROM s WHERE split = 'test') SELECT * FROM v INTERSECT SELECT * FROM t""")
def set_intersect_families(spark, d):
    s = order_splits(spark, d)
    return s.filter("split = 'val'").select("o_custkey").intersect(s.filter("split = 'test'").select("o_custkey"))


@query("""WITH a AS (SELECT o_custkey FROM orders WHERE o_orderpriority < '3'), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def set_symmetric_diff(spark, d):
    o = table(spark, d, "orders")
    return rel.symmetric_difference(o.filter("o_orderpriority < '3'").select("o_custkey"), o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 15")
def sort_head(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(15)


@query(f"SELECT o_orderkey, {sql_u01("'7:' || o_orderkey")} AS u FROM orders ORDER BY u, o_orderkey LIMIT 100")
def sample_without_replacement(spark, d):
    return rel.sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "7", 100)


@query("""WITH c AS (SELECT year(o_orderdate)::BIGINT AS yr, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT *, 1000 * n / sum(n) OVER () AS e FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY e - floor(e) DESC, yr) AS k, 1000 - sum(floor(e)) OVER () AS rest FROM q)
SELECT yr, n, (floor(e) + (k <= rest)::INT)::BIGINT AS quota FROM r""")
def sample_quota(spark, d):
    counts = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("yr")).agg(F.count("*").alias("n"))
    return rel.quotas(counts, "yr", "n", 1000)


@query(f"""WITH r AS (SELECT o_orderkey, year(o_orderdate)::BIGINT AS yr, row_number() OVER (PARTITION BY yr ORDER BY {sql_u01("'adm:' || o_orderkey")}, o_orderkey) AS k FROM orders) SELECT o_orderkey, yr FROM r WHERE k <= 50""")
def sample_quota_admission(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("yr"))
    return rel.capped_groups(o, "yr", "o_orderkey", 50, "adm").select("o_orderkey", "yr")


@query("SELECT o_custkey, arg_min(o_orderkey, sha256('9:' || o_custkey || ':' || o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def sample_one_per_group(spark, d):
    key = F.sha2(F.concat_ws(":", F.lit("9"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")), 256)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", key).alias("o_orderkey"))


@query(f"""WITH s AS ({SPLIT}), n AS (SELECT count(*) AS n FROM s WHERE split = 'train'), l AS (SELECT unnest([0.0, 0.01, 0.02, 0.05]) AS level)
SELECT level::DOUBLE AS level, round_even(level::DOUBLE * n / (1 - level::DOUBLE), 0)::BIGINT AS positives FROM l, n""")
def sample_contamination_size(spark, d):
    n = order_splits(spark, d).filter("split = 'train'").agg(F.count("*").alias("n"))
    sizes = F.array(*(F.struct(F.lit(v).alias("level"), contamination_size(v, F.col("n")).alias("positives")) for v in (0.0, 0.01, 0.02, 0.05)))
    return n.select(F.inline(sizes))


@query(f"""WITH s AS ({SPLIT}), f AS (SELECT unnest([0.1, 0.25, 0.5, 1.0])::DOUBLE AS frac),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_u01("'lc:' || o_orderkey")}, o_orderkey) AS k, count(*) OVER () AS n FROM s WHERE split = 'train')
SELECT frac, o_orderkey FROM r, f WHERE k <= greatest(1, round_even(frac * n, 0))""")
def sample_train_fraction(spark, d):
    train = order_splits(spark, d).filter("split = 'train'").select("o_orderkey")
    n = train.count()
    placed = rel.shuffled(train, "o_orderkey", "lc")
    picks = [placed.filter(F.col("place") < max(1, round(f * n))).select(F.lit(f).alias("frac"), "o_orderkey") for f in (0.1, 0.25, 0.5, 1.0)]
    return rel.union_all(*picks)


@query(f"""SELECT frac, rep, count(*) AS n, avg(o_totalprice) AS mean_price FROM (SELECT o_totalprice, frac::DOUBLE AS frac, rep, {sql_u01("'den:' || rep || ':' || o_orderkey")} AS u
FROM orders, (SELECT unnest([0.25, 0.5]) AS frac), range(3) t(rep)) WHERE u < frac GROUP BY ALL""")
def sample_density_matched(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("rep"), F.array(F.lit(0.25), F.lit(0.5)).alias("fs"))
    o = o.withColumn("u", u01(F.concat(F.lit("den:"), F.col("rep").cast("string"), F.lit(":"), F.col("o_orderkey").cast("string"))))
    return o.select("*", F.explode("fs").alias("frac")).filter("u < frac").groupBy("frac", "rep").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"))


@query(f"""WITH s AS ({SPLIT}), draws AS (SELECT level, seed, o_custkey, o_totalprice, row_number() OVER (PARTITION BY level, seed ORDER BY {sql_u01("seed || ':' || s.o_orderkey")}, s.o_orderkey) AS k
  FROM s JOIN orders USING (o_orderkey, o_custkey), (SELECT unnest([50, 100]) AS level), range(2) t(seed) WHERE split = 'test')
SELECT level::INT AS level, seed, count(*) AS n, count(DISTINCT o_custkey) AS families, avg((o_totalprice > 200000)::INT) AS flagged FROM draws WHERE k <= level GROUP BY ALL""")
def draw_composition(spark, d):
    pool = order_splits(spark, d).filter("split = 'test'").join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    draws = [rel.sample(pool, "o_orderkey", str(seed), level).select(F.lit(level).alias("level"), F.lit(seed).cast("bigint").alias("seed"), "o_custkey", "o_totalprice") for level in (50, 100) for seed in range(2)]
    return rel.union_all(*draws).groupBy("level", "seed").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("families"), F.avg((F.col("o_totalprice") > 200000).cast("int")).alias("flagged"))
