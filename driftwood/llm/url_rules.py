"""URL rules by a sort-merge range join: DataFrame functions only.

A rule (host, path) fits its host and all subdomains where the path starts with the rule's.  Under the canonical key
"reversed host, then path" the URLs that a rule fits are one interval for each of their parent hosts, so every URL is
placed once under each parent host that has rules.  Rules and URLs are sorted together by key; the sweep carries the
stack of rules that are active where the last rule began (it and the rules that nest it), and a URL takes the innermost
one that still holds.  Of the parent hosts' findings the longest rule wins.

A hot host is dealt over SALTS sweeps; the rules, not the URLs, are repeated for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwood.llm.common import table

SALTS = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules as a DataFrame (host, path, verdict)."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(rows))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int = SALTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url), by rules(host, path, verdict).

    Null urls and those without :// have an empty host and path, no rule and the default verdict.  Of rules of equal
    host and path a block wins; equally long rules: the greater as a string.  Repeated rows stay repeated.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    host, path = host_path(F.col("url"))
    pages = pages.select("page_id", "url").withColumns({"host": host, "path": path})

    # each rule with the rules that nest it, outermost first
    prefixes = rules.select(F.col("host"), F.col("path").alias("own"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("path"))
    stacks = prefixes.join(rules, ["host", "path"]).groupBy("host", F.col("own").alias("path")).agg(F.sort_array(F.collect_list(F.struct(F.length("path").alias("n"), "path", "verdict"))).alias("stack"))

    labels = F.reverse(F.split("host", r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    points = pages.filter("host <> ''").select("page_id", "url", "path", F.explode(parents).alias("key")) if most else pages.limit(0).select("page_id", "url", "path", F.lit("").alias("key"))
    points = points.join(rules.select(_reversed(F.col("host")).alias("key")).distinct(), "key", "left_semi")
    points = points.select("key", "path", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"), "page_id", "url", F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("array<struct<n:int,path:string,verdict:string>>").alias("stack"))
    starts = stacks.select(_reversed(F.col("host")).alias("key"), "path", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("host").alias("rule_host"), "stack")
    starts = starts.withColumn("page_id", F.col("page_id").cast(points.schema["page_id"].dataType))
    sweep = Window.partitionBy("key", "salt").orderBy("path", F.col("stack").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = points.unionByName(starts).withColumns({"active": F.last("stack", True).over(sweep), "on": F.last("rule_host", True).over(sweep)}).filter("rule_host is null and active is not null")
    held = met.withColumn("top", F.try_element_at(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(-1))).filter("top is not null")
    rule = F.concat("on", "top.path")
    best = held.groupBy("page_id", "url").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("top.verdict").alias("verdict"))).alias("best"))
    best = best.select(F.col("page_id").alias("id"), F.col("url").alias("u"), "best.rule", "best.verdict")
    return pages.join(best, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("url") == F.col("u")), "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP9_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, RULES))}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parsed AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '') AS host,
                  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
numbered AS (SELECT *, row_number() OVER () AS k FROM parsed),
hits AS (SELECT k, rule_host || rule_path AS rule, rule_verdict,
                row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path DESC) AS place
         FROM numbered, rules
         WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM hits WHERE place = 1) USING (k)
"""
