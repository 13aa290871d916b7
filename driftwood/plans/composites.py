"""Names, splits and the summaries that several operators feed: learning curves, grids, twin rates, label noise."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.functions.scalars import u01
from driftwood.operators import ranking, relational as rel
from driftwood.operators.selection import percentiles
from driftwood.plans.metrics import SCORES, score_rows, sql_auc
from driftwood.plans.registry import query
from driftwood.plans.relational import SEEDS, seeded_scores, sql_u01
from driftwood.plans.text import FULL_NOISE, docs, noise_flags, sql_pattern
from driftwood.sources.artefacts import cached, load_bundle, preflight, save_bundle
from driftwood.sources.scratch import checkpointed, shared_folder
from driftwood.sources.tables import table

# Distributions whose module has another name.
ALIASES = {
    "beautifulsoup4": "bs4", "pyyaml": "yaml", "pillow": "PIL", "scikit-learn": "sklearn", "python-dateutil": "dateutil", "opencv-python": "cv2", "opencv-python-headless": "cv2",
    "pyjwt": "jwt", "attrs": "attr", "pycryptodome": "Crypto", "pycryptodomex": "Cryptodome", "typing-extensions": "typing_extensions", "pyopenssl": "OpenSSL", "python-dotenv": "dotenv",
    "discord-py": "discord", "psycopg2-binary": "psycopg2", "pymupdf": "fitz", "pywin32": "win32api", "scikit-image": "skimage", "protobuf": "google", "msgpack-python": "msgpack",
    "python-telegram-bot": "telegram", "websocket-client": "websocket", "pyserial": "serial", "pyusb": "usb", "pygobject": "gi", "faiss-cpu": "faiss", "tensorflow-gpu": "tensorflow",
}

#: Distribution names: words of the parts, some of them with a prefix, and the known aliases.
DISTRIBUTIONS = f"""d AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'python-' || split_part(p_name, ' ', 1) WHEN 1 THEN replace(p_name, ' ', '.') WHEN 2 THEN list_element({list(ALIASES)}, (p_partkey % {len(ALIASES)} + 1)::INT) ELSE replace(p_name, ' ', '-') END AS dist FROM part)"""


@query(f"WITH {DISTRIBUTIONS}, a AS (SELECT unnest({list(ALIASES)}) AS dist, unnest({list(ALIASES.values())}) AS alias) SELECT id, dist, coalesce(alias, replace(replace(CASE WHEN starts_with(dist, 'python-') THEN dist[8:] ELSE dist END, '-', '_'), '.', '_')) AS module FROM d LEFT JOIN a USING (dist)")
def join_alias_module(spark, d):
    """The module of each distribution: from the alias table (a few rows, broadcast), else by rule."""
    k, names = F.col("p_partkey") % 4, F.array(*map(F.lit, ALIASES))
    dist = F.when(k == 0, F.concat(F.lit("python-"), F.split_part("p_name", F.lit(" "), F.lit(1)))).when(k == 1, F.translate("p_name", " ", ".")).when(k == 2, F.element_at(names, (F.col("p_partkey") % len(ALIASES) + 1).cast("int")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), dist.otherwise(F.translate("p_name", " ", "-")).alias("dist"))
    rule = F.translate(F.when(F.startswith("dist", F.lit("python-")), F.substring("dist", 8, 10_000)).otherwise(F.col("dist")), "-.", "__")
    return rows.join(F.broadcast(spark.createDataFrame(list(ALIASES.items()), "dist string, alias string")), "dist", "left").select("id", "dist", F.coalesce("alias", rule).alias("module"))


@query("""WITH h AS (SELECT p_partkey AS id, sha256('salt:' || regexp_replace(lower(p_name), '[-_. ]+', '-', 'g')) AS x FROM part),
u AS (SELECT id, ('0x' || x[1:13])::BIGINT / 16.0::DOUBLE ** 13 + ('0x' || x[14:26])::BIGINT / 16.0::DOUBLE ** 26 AS u FROM h) SELECT id, u, CASE WHEN u < 0.5 THEN 'train' WHEN u < 0.7 THEN 'val' ELSE 'test' END AS split FROM u""")
def split_full_width(spark, d):
    """A salted split by name over all digits of the hash that a double holds."""
    x = F.sha2(F.concat(F.lit("salt:"), F.regexp_replace(F.lower("p_name"), "[-_. ]+", "-")), 256)
    digits = lambda at, n: F.conv(F.substring(x, at, 13), 16, 10).cast("bigint") / F.lit(16.0**n)
    u = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (digits(1, 13) + digits(14, 26)).alias("u"))
    return u.withColumn("split", F.when(F.col("u") < 0.5, "train").when(F.col("u") < 0.7, "val").otherwise("test"))


NAMED = "n AS (SELECT p_partkey AS id, replace(replace(p_brand, '#', CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '_.' ELSE '.' END), 'B', 'B_') AS name FROM part)"


@query(f"""WITH {NAMED}, p AS (SELECT id, name, regexp_replace(name, '[-_.]+', '-', 'g') AS dash FROM n),
v AS (SELECT DISTINCT id, v FROM (SELECT id, unnest([name, dash, replace(dash, '-', '_'), replace(dash, '-', '.'), replace(dash, '-', '')]) AS v FROM p UNION ALL SELECT id, lower(unnest([name, dash, replace(dash, '-', '_'), replace(dash, '-', '.'), replace(dash, '-', '')])) FROM p) WHERE length(v) >= 2)
SELECT id, string_agg(v, ' ' ORDER BY length(v) DESC, v) AS variants FROM v GROUP BY id""")
def feat_name_variants(spark, d):
    """All common spellings of a name, the longest first."""
    k = F.col("p_partkey") % 3
    name = F.replace(F.replace(F.col("p_brand"), F.lit("#"), F.when(k == 0, "-").when(k == 1, "_.").otherwise(".")), F.lit("B"), F.lit("B_"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name")).withColumn("dash", F.regexp_replace("name", r"[-_.]+", "-"))
    forms = F.array("name", "dash", *(F.replace(F.col("dash"), F.lit("-"), F.lit(c)) for c in ("_", ".", "")))
    forms = F.filter(F.array_distinct(F.concat(forms, F.transform(forms, F.lower))), lambda v: F.length(v) >= 2)
    ordered = F.array_sort(F.transform(forms, lambda v: F.struct((-F.length(v)).alias("size"), v.alias("v"))))
    return rows.select("id", F.array_join(F.transform(ordered, lambda s: s["v"]), " ").alias("variants"))


@query("""SELECT p_partkey AS id, ltrim(lower(regexp_replace(v, '[-_.]+', '.', 'g')), 'v') AS version FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'v1_' || p_size WHEN 1 THEN '2.' || p_size || '-rc.X' ELSE 'V' || p_size || '..0' END AS v FROM part)""")
def feat_version_normalised(spark, d):
    """Separators become dots, letters lower case, a leading v goes: the form for versions that PEP 440 doesn't know."""
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    v = F.when(k == 0, F.concat(F.lit("v1_"), size)).when(k == 1, F.concat(F.lit("2."), size, F.lit("-rc.X"))).otherwise(F.concat(F.lit("V"), size, F.lit("..0")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.lower(F.regexp_replace(v, r"[-_.]+", ".")), "^v+", "").alias("version"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS body, split_part(coalesce(text, ''), chr(10), 1) AS setup FROM documents)
SELECT doc_id, length(setup) AS setup_size, CASE WHEN length(body) > 0 THEN round(length(setup)::DOUBLE / length(body), 4) ELSE 0.0::DOUBLE END AS setup_share, contains(setup, 'sys.argv')::INT AS has_argv, contains(setup, 'cmdclass')::INT AS has_cmdclass FROM t""")
def feat_setup_script(spark, d):
    """Size and share of the setup script (a document's first line plays it) and what it touches."""
    body = F.coalesce("text", F.lit(""))
    setup = F.split_part(body, F.lit("\n"), F.lit(1))
    share = F.when(F.length(body) > 0, F.round(F.length(setup) / F.length(body), 4)).otherwise(0.0)
    return docs(spark, d).select("doc_id", F.length(setup).cast("bigint").alias("setup_size"), share.alias("setup_share"), F.contains(setup, F.lit("sys.argv")).cast("int").alias("has_argv"), F.contains(setup, F.lit("cmdclass")).cast("int").alias("has_cmdclass"))


@query("""WITH z AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s, avg(length(p_name)) AS nm, stddev_pop(length(p_name)) AS ns FROM part)
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE round((p_size - m) / s, 9) END AS size, round((length(p_name) - nm) / ns, 9) AS name_length, CASE WHEN p_partkey % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_context FROM part, z""")
def feat_context_nodes(spark, d):
    """Context nodes (a quarter of the parts) have neutral archive features after scaling, real name features, and a flag."""
    p = table(spark, d, "part")
    z = p.agg(F.avg("p_size").alias("m"), F.stddev_pop("p_size").alias("s"), F.avg(F.length("p_name")).alias("nm"), F.stddev_pop(F.length("p_name")).alias("ns"))
    context = F.col("p_partkey") % 4 == 0
    return p.crossJoin(z).select(F.col("p_partkey").alias("id"), F.when(context, 0.0).otherwise(F.round((F.col("p_size") - F.col("m")) / F.col("s"), 9)).alias("size"), F.round((F.length("p_name") - F.col("nm")) / F.col("ns"), 9).alias("name_length"), context.cast("double").alias("is_context"))


@query("SELECT year, count(*) AS archives FROM (SELECT year(max(l_shipdate)) AS year FROM lineitem WHERE l_partkey % 10 > 0 GROUP BY l_orderkey) GROUP BY 1")
def year_histogram(spark, d):
    """Archives (orders) by the year of their latest member; unreadable members (a tenth of the parts) are left out."""
    li = table(spark, d, "lineitem").filter("l_partkey % 10 > 0")
    return li.groupBy("l_orderkey").agg(F.year(F.max("l_shipdate")).cast("bigint").alias("year")).groupBy("year").agg(F.count("*").alias("archives"))


FRACTIONS = [0.1, 0.25, 0.5, 1.0]
CURVE_ROWS = f"""r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity AS y, l_returnflag = 'R' AS label, l_linestatus = 'O' AS test FROM lineitem),
fit AS (SELECT f, seed, median(x) AS mx, median(y) AS my, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS sx, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS sy, count(*) AS n_train
  FROM r, (SELECT unnest({FRACTIONS})::DOUBLE AS f), range(3) t(seed) WHERE NOT test AND NOT label AND {sql_u01("'curve:' || seed || ':' || l_orderkey")} < f GROUP BY f, seed),
s AS (SELECT f, seed, label, greatest(abs(x - mx) / sx, abs(y - my) / sy) AS score FROM (SELECT * FROM r WHERE test OR label) r, fit)"""


@query(f"WITH {CURVE_ROWS}, a AS ({sql_auc('s', 'f, seed', '1.0')}), q AS (SELECT f, seed, quantile_cont(score, 0.95) AS t FROM s WHERE NOT label GROUP BY ALL), c AS (SELECT f, seed, avg((score > t)::INT) AS tpr FROM s JOIN q USING (f, seed) WHERE label GROUP BY ALL) SELECT f, round(avg(auc), 6) AS auc, round(avg(tpr), 6) AS tpr5, min(n_train) AS least_train FROM a JOIN c USING (f, seed) JOIN fit USING (f, seed) GROUP BY f")
def learning_curve(spark, d):
    """Fractions of the training rows x seeds: a robust-distance detector is fitted on each and scored on the same rows.

    Rows that are equal in what a run sees of them are counted once, before they meet the runs.
    """
    r = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_returnflag") == "R").alias("label"), (F.col("l_linestatus") == "O").alias("test"))
    runs = [(f, s) for f in FRACTIONS for s in range(3)]
    u = [u01(F.concat(F.lit(f"curve:{k}:"), F.col("l_orderkey").cast("string"))).alias(f"u{k}") for k in range(3)]
    train = r.filter("not test and not label").select("x", "y", *u).groupBy("x", "y").agg(*(F.count_if(F.col(f"u{s}") < f).alias(f"n{k}") for k, (f, s) in enumerate(runs)))
    train = checkpointed(train)

    def drawn(*values):
        """(f, seed, values, n): how many training rows of a run have the values."""
        own = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(s).cast("long").alias("seed"), F.col(f"n{k}").alias("n")) for k, (f, s) in enumerate(runs)))).alias("run")
        return train.groupBy(*values).agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(runs)))).select(*values, own).select(*values, "run.*").filter("n > 0")

    fit = drawn().withColumnRenamed("n", "n_train")
    for c in ("x", "y"):
        fit = fit.join(percentiles(drawn(c), c, [0.25, 0.5, 0.75], ["f", "seed"], "n").withColumnRenamed("q", f"q{c}"), ["f", "seed"])
    apart = lambda c, q: F.abs(F.col(c) - F.col(q)[1]) / (F.col(q)[2] - F.col(q)[0])
    rows, fit = checkpointed(r.filter("test or label").groupBy("x", "y", "label").agg(F.count("*").alias("n"))), checkpointed(fit)  # of twelve rows
    by = ["f", "seed"]
    s = rows.crossJoin(F.broadcast(fit)).select(*by, "label", "n", F.greatest(apart("x", "qx"), apart("y", "qy")).alias("score"))
    s = checkpointed(s.groupBy(*by, "score", "label").agg(F.sum("n").alias("n")))
    a = ranking.auc(s, "score", F.col("label"), F.col("n").cast("double"), by).select(*by, "auc")
    scored = s.filter("score is not null")
    c = ranking.caught(scored, ranking.thresholds(scored, "score", F.col("label"), [0.05], by, "n"), "score", F.col("label"), F.col("n"), by).select(*by, F.col("tpr_w").alias("tpr"))
    return a.join(c, by).join(fit.select(*by, "n_train"), by).groupBy("f").agg(F.round(F.avg("auc"), 6).alias("auc"), F.round(F.avg("tpr"), 6).alias("tpr5"), F.min("n_train").alias("least_train"))


TWINS = f"""a AS (SELECT o_orderkey AS id, o_custkey AS family, o_orderdate AS artifact, o_orderstatus = 'F' AS label FROM orders),
pools AS (SELECT f, rep, a.* FROM a, (SELECT unnest([0.25, 0.5])::DOUBLE AS f), range(3) t(rep) WHERE NOT label OR {sql_u01("'twin:' || rep || ':' || id")} < f),
k AS (SELECT f, rep, artifact, count(*) AS n, count(*) FILTER (WHERE NOT label) AS neg FROM pools GROUP BY ALL),
w AS (SELECT p.*, n > 1 AS twin, neg - (NOT label)::INT > 0 AS normal_twin, 1.0::DOUBLE / count(*) OVER (PARTITION BY p.f, p.rep, family, label) AS w FROM pools p JOIN k USING (f, rep, artifact)),
rates AS (SELECT f, rep, count(*) FILTER (WHERE label) AS n_malicious, avg(twin::INT) FILTER (WHERE label) AS malicious, sum(w * twin::INT) FILTER (WHERE label) / sum(w) FILTER (WHERE label) AS malicious_fw, avg(twin::INT) FILTER (WHERE NOT label) AS normal, avg(normal_twin::INT) FILTER (WHERE label) AS with_normal FROM w GROUP BY ALL)"""


@query(f"WITH {TWINS} SELECT f, min(n_malicious) AS least_malicious, round(avg(malicious), 6) AS malicious, round(stddev_samp(malicious), 6) AS malicious_sd, round(avg(malicious_fw), 6) AS malicious_fw, round(avg(normal), 6) AS normal, round(avg(with_normal), 6) AS with_normal, round(avg(malicious) / nullif(avg(normal), 0), 6) AS ratio, round(avg(malicious_fw) / nullif(avg(normal), 0), 6) AS ratio_fw FROM rates GROUP BY f")
def twin_rate_ratio(spark, d):
    """How much more often positives share an artefact than negatives do, at several densities of positives."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("family"), F.col("o_orderdate").alias("artifact"), (F.col("o_orderstatus") == "F").alias("label"))
    draws = spark.createDataFrame([(f, r) for f in (0.25, 0.5) for r in range(3)], "f double, rep long")
    pools = a.crossJoin(F.broadcast(draws)).filter(~F.col("label") | (u01(F.concat(F.lit("twin:"), F.col("rep").cast("string"), F.lit(":"), F.col("id").cast("string"))) < F.col("f")))  # of six rows
    k = pools.groupBy("f", "rep", "artifact").agg(F.count("*").alias("n"), F.count_if(~F.col("label")).alias("neg"))
    sizes = pools.groupBy("f", "rep", "family", "label").agg(F.count("*").alias("size"))
    rows = pools.join(k, ["f", "rep", "artifact"]).join(sizes, ["f", "rep", "family", "label"])
    twin, own = (F.col("n") > 1).cast("int"), (F.col("neg") - (~F.col("label")).cast("int") > 0).cast("int")
    positive = lambda v: F.when(F.col("label"), v)
    rates = rows.groupBy("f", "rep").agg(
        F.count_if("label").alias("n_malicious"), F.avg(positive(twin)).alias("m"), (F.sum(positive(twin / F.col("size"))) / F.sum(positive(1 / F.col("size")))).alias("mf"),
        F.avg(F.when(~F.col("label"), twin)).alias("no"), F.avg(positive(own)).alias("wn"),
    )
    ratio = lambda c: F.round(F.try_divide(F.avg(c), F.avg("no")), 6)
    mean = lambda c: F.round(F.avg(c), 6)
    return rates.groupBy("f").agg(F.min("n_malicious").alias("least_malicious"), mean("m").alias("malicious"), F.round(F.stddev_samp("m"), 6).alias("malicious_sd"), mean("mf").alias("malicious_fw"), mean("no").alias("normal"), mean("wn").alias("with_normal"), ratio("m").alias("ratio"), ratio("mf").alias("ratio_fw"))


#: Result files of a tuning grid: one row a seed, settings in the file's name.
RUNS = f"""runs AS (SELECT 'results/valseeds_srtune_' || (CASE o_custkey % 3 WHEN 0 THEN 'infonce' WHEN 1 THEN 'triplet' ELSE 'dgi' END) || '_nu0.' || (1 + o_custkey % 2) || '_k' || (5 * (1 + o_custkey % 4)) || CASE WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '.csv' END AS file, seed, score FROM {SEEDS})"""
SETTING = r"_srtune_(\w+?)_nu([0-9.]+)_k(\d+)\.csv$"


@query(f"""WITH {RUNS}, m AS (SELECT regexp_extract(file, '{SETTING}', 1) AS loss, regexp_extract(file, '{SETTING}', 2)::DOUBLE AS nu, regexp_extract(file, '{SETTING}', 3)::BIGINT AS k, seed, avg(score) AS score FROM runs WHERE regexp_matches(file, '{SETTING}') GROUP BY ALL),
t AS (SELECT loss, nu, k, avg(score) AS val, stddev_samp(score) AS sd, count(*) AS seeds FROM m GROUP BY ALL), n AS (SELECT loss, count(*) AS found FROM t GROUP BY 1)
SELECT loss, nu, k, round(val, 9) AS val, round(sd, 9) AS sd, seeds, found, found < 8 AS runs_missing FROM t JOIN n USING (loss) QUALIFY row_number() OVER (PARTITION BY loss ORDER BY val DESC, nu, k) = 1""")
def run_grid_collection(spark, d):
    """Settings are read from the names of result files; the best of each loss, and whether runs of its grid are missing."""
    s = seeded_scores(spark, d)
    c = F.col("o_custkey")
    loss = F.when(c % 3 == 0, "infonce").when(c % 3 == 1, "triplet").otherwise("dgi")
    file = F.concat(F.lit("results/valseeds_srtune_"), loss, F.lit("_nu0."), (1 + c % 2).cast("string"), F.lit("_k"), (5 * (1 + c % 4)).cast("string"), F.when(F.col("o_orderkey") % 11 == 0, ".txt").otherwise(".csv"))
    part = lambda n: F.regexp_extract("file", SETTING, n)
    m = s.select(file.alias("file"), "seed", "score").filter(F.col("file").rlike(SETTING)).groupBy(part(1).alias("loss"), part(2).cast("double").alias("nu"), part(3).cast("bigint").alias("k"), "seed").agg(F.avg("score").alias("score"))
    t = m.groupBy("loss", "nu", "k").agg(F.avg("score").alias("val"), F.stddev_samp("score").alias("sd"), F.count("*").alias("seeds"))
    best = t.groupBy("loss").agg(F.min(F.struct((-F.col("val")).alias("least"), "nu", "k", "val", "sd", "seeds")).alias("b"), F.count("*").alias("found"))
    return best.select("loss", "b.nu", "b.k", F.round("b.val", 9).alias("val"), F.round("b.sd", 9).alias("sd"), "b.seeds", "found", (F.col("found") < 8).alias("runs_missing"))


GAINS = f"""g AS (SELECT p_partkey % 40 AS feature, depth, avg({sql_u01("'var:' || p_partkey % 40")}) AS variability, avg(CASE WHEN p_partkey % 40 <> 7 THEN {sql_u01("'gain:' || depth || ':' || p_partkey")} END) AS gain FROM part, range(2) t(depth) GROUP BY ALL)"""


@query(f"""WITH {GAINS}, m AS (SELECT *, (rank() OVER (PARTITION BY depth ORDER BY variability) + (count(*) OVER (PARTITION BY depth, variability) - 1) / 2.0) AS rv, (rank() OVER (PARTITION BY depth ORDER BY gain) + (count(*) OVER (PARTITION BY depth, gain) - 1) / 2.0) AS rg FROM g WHERE gain IS NOT NULL),
rho AS (SELECT depth, corr(rv, rg) AS rho FROM m GROUP BY 1)
SELECT depth, CASE WHEN variability <= 0.05 THEN 'almost constant' WHEN variability <= 0.25 THEN 'rare' ELSE 'common' END AS variability_group, count(*) AS features, round(avg(gain), 6) AS gain, round(any_value(rho), 6) AS rho FROM m JOIN rho USING (depth) GROUP BY ALL""")
def sensitivity_summary(spark, d):
    """Mean gain of the features by depth and by how much they vary, undefined ones left out, and the rank correlation of both."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("feature"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("depth"))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    gain = F.when(F.col("feature") != 7, u01(text("gain:", F.col("depth"), ":", F.col("p_partkey"))))
    m = p.groupBy("feature", "depth").agg(F.avg(u01(text("var:", F.col("feature")))).alias("variability"), F.avg(gain).alias("gain")).filter("gain is not null")
    ranked = ranking.midrank(ranking.midrank(m, "variability", ["depth"], "rv"), "gain", ["depth"], "rg")
    rho = ranked.groupBy("depth").agg(F.corr("rv", "rg").alias("rho"))
    group = F.when(F.col("variability") <= 0.05, "almost constant").when(F.col("variability") <= 0.25, "rare").otherwise("common")
    return m.withColumn("variability_group", group).join(F.broadcast(rho), "depth").groupBy("depth", "variability_group").agg(F.count("*").alias("features"), F.round(F.avg("gain"), 6).alias("gain"), F.round(F.any_value("rho"), 6).alias("rho"))


#: Each pattern has a group of its own; no bare group is in the way.
NOISE_ROWS = f"""n AS (SELECT d.doc_id, d.source AS family, CASE WHEN {sql_u01("'s:' || d.doc_id")} < 0.5 THEN 'train' ELSE 'test' END AS split, {", ".join(f"regexp_matches(coalesce(text, ''), '{sql_pattern(p)}') AS {k}" for k, p in FULL_NOISE.items())}, length(coalesce(text, '')) > 1000 AS caught FROM documents d)"""
NOISE_LONG = " UNION ALL ".join([f"SELECT '{k}' AS category, * FROM n WHERE {k}" for k in FULL_NOISE] + [f"SELECT 'any', * FROM n WHERE {' OR '.join(FULL_NOISE)}", "SELECT 'self_declared', * FROM n WHERE research OR ctf"])


@query(f"WITH {NOISE_ROWS}, c AS ({NOISE_LONG}), t AS (SELECT split, count(*) AS all_, sum(caught::INT) AS all_caught FROM n GROUP BY 1) SELECT category, split, count(*) AS n, round(count(*) / any_value(all_), 6) AS share, count(DISTINCT family) AS families, round(avg(caught::INT), 6) AS caught_candidates, round((any_value(all_caught) - sum(caught::INT)) / nullif(any_value(all_) - count(*), 0), 6) AS caught_rest FROM c JOIN t USING (split) GROUP BY ALL")
def label_noise_summary(spark, d):
    """Counts, shares and families of each category of label noise by split, and what is caught of it and of the rest."""
    t = F.col("text")
    n = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text")).select("doc_id", F.col("source").alias("family"), F.when(u01(F.concat(F.lit("s:"), F.col("doc_id").cast("string"))) < 0.5, "train").otherwise("test").alias("split"), *(hit.alias(k) for k, hit in noise_flags(t, F.col("low")).items()), (F.length(t) > 1000).cast("int").alias("caught"))
    some = {**{k: F.col(k) for k in FULL_NOISE}, "any": F.array_contains(F.array(*FULL_NOISE), True), "self_declared": F.col("research") | F.col("ctf")}
    tags = F.array_compact(F.array(*(F.when(c, k) for k, c in some.items())))
    total = n.groupBy("split").agg(F.count("*").alias("all"), F.sum("caught").alias("all_caught"))
    c = n.select("split", "family", "caught", F.explode(tags).alias("category")).groupBy("category", "split").agg(F.count("*").alias("n"), F.countDistinct("family").alias("families"), F.sum("caught").alias("hit"))
    rest = F.try_divide(F.col("all_caught") - F.col("hit"), F.col("all") - F.col("n"))
    return c.join(F.broadcast(total), "split").select("category", "split", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), "families", F.round(F.col("hit") / F.col("n"), 6).alias("caught_candidates"), F.round(rest, 6).alias("caught_rest"))


EXTRA = [0.002, 0.005, 0.01, 0.02, 0.05]
HARD = "l_quantity <= 25"


def _fw(name, q, rows="label"):
    return f"round(sum(w) FILTER (WHERE {rows} AND score > {q}) / sum(w) FILTER (WHERE {rows}), 6) AS {name}"


@query(f"""WITH {SCORES}, q AS (SELECT quantile_cont(score, {[1 - a for a in EXTRA]}) AS q FROM s WHERE NOT label),
p AS (SELECT {", ".join(f"round(avg((score > q[{k + 1}])::INT) FILTER (WHERE label), 6) AS tpr_{k}, " + _fw(f"tpr_{k}_fw", f"q[{k + 1}]") for k in range(len(EXTRA)))},
 {_fw("tpr1_hard_fw", "q[3]", f"label AND {HARD}")}, {_fw("tpr1_flagged_fw", "q[3]", f"label AND NOT {HARD}")}, round(avg((l_quantity > 45)::INT) FILTER (WHERE label), 6) AS rule_tpr, round(sum(w) FILTER (WHERE label AND l_quantity > 45) / sum(w) FILTER (WHERE label), 6) AS rule_tpr_fw,
 round(avg((l_quantity > 45)::INT) FILTER (WHERE NOT label), 6) AS rule_fpr FROM s, q),
a1 AS ({sql_auc('s', weight='1.0')}), a2 AS ({sql_auc('s')}), a3 AS ({sql_auc(f'(SELECT * FROM s WHERE NOT label OR {HARD})', weight='1.0')}), a4 AS ({sql_auc(f'(SELECT * FROM s WHERE NOT label OR NOT {HARD})', weight='1.0')})
SELECT p.*, round(a1.auc, 6) AS auc, round(a2.auc, 6) AS auc_fw, round(a3.auc, 6) AS auc_hard, round(a4.auc, 6) AS auc_flagged FROM p, a1, a2, a3, a4""")
def metric_full_suite(spark, d):
    """All point estimates: areas over all, hard and flagged positives, shares caught at five rates, and a fixed rule's own."""
    s = score_rows(spark, d)
    label, hard, rule, w = F.col("label"), F.col("l_quantity") <= 25, F.col("l_quantity") > 45, F.col("w")
    q = percentiles(s.filter(~label), "score", [1 - a for a in EXTRA])
    above = lambda k: F.col("score") > F.col("q")[k]
    share = lambda hit, rows: F.round(F.avg(F.when(rows, hit.cast("int"))), 6)
    fw = lambda hit, rows: F.round(F.sum(F.when(rows & hit, w)) / F.sum(F.when(rows, w)), 6)
    p = s.crossJoin(F.broadcast(q)).agg(  # of one row
        *(x for k in range(len(EXTRA)) for x in (share(above(k), label).alias(f"tpr_{k}"), fw(above(k), label).alias(f"tpr_{k}_fw"))),
        fw(above(2), label & hard).alias("tpr1_hard_fw"), fw(above(2), label & ~hard).alias("tpr1_flagged_fw"), share(rule, label).alias("rule_tpr"), fw(rule, label).alias("rule_tpr_fw"), share(rule, ~label).alias("rule_fpr"),
    )
    areas = {"auc": (s, None), "auc_fw": (s, w), "auc_hard": (s.filter(~label | hard), None), "auc_flagged": (s.filter(~label | ~hard), None)}
    for name, (rows, weight) in areas.items():
        p = p.crossJoin(ranking.auc(rows, "score", label, weight).select(F.round("auc", 6).alias(name)))
    return p


POPULATIONS = {"first": "l_shipdate < TIMESTAMP '1994-01-01'", "later": "l_shipdate >= TIMESTAMP '1994-01-01'", "new": "l_shipdate >= TIMESTAMP '1996-01-01'", "estab": "l_shipdate < TIMESTAMP '1996-01-01'"}
GROUPED = " UNION ALL ".join(f"SELECT '{g}' AS grp, * FROM s WHERE label OR {c}" for g, c in POPULATIONS.items())


@query(f"""WITH {SCORES}, g AS ({GROUPED}), a AS ({sql_auc('g', 'grp')}), t AS (SELECT quantile_cont(score, 0.99) AS t FROM s WHERE NOT label), q AS (SELECT grp, quantile_cont(score, 0.99) AS q FROM g WHERE NOT label GROUP BY 1 HAVING count(*) >= 20),
m AS (SELECT grp, avg((score > t)::INT) FILTER (WHERE NOT label) AS fpr, sum(w) FILTER (WHERE label AND score > q) / sum(w) FILTER (WHERE label) AS tpr FROM g JOIN q USING (grp), t GROUP BY grp)
SELECT grp, round(auc, 6) AS auc_fw, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr1_fw, round(tpr / 66.0 / (tpr / 66.0 + 0.01 * 65 / 66.0), 6) AS prec65 FROM m JOIN a USING (grp)""")
def metric_population_suite(spark, d):
    """For each (overlapping) group of negatives of twenty or more: area, false alarms at the global threshold, share caught at its own."""
    s, label, w = score_rows(spark, d), F.col("label"), F.col("w")
    # rows of one score that lie in the same groups are counted once, before they meet the groups
    s = s.select("score", "label", "w", *(F.coalesce(label | F.expr(c), F.lit(False)).alias(g) for g, c in POPULATIONS.items()))
    s = checkpointed(s.groupBy("score", "label", *POPULATIONS).agg(F.count("*").alias("n"), F.sum("w").alias("w")))
    member = F.array_compact(F.array(*(F.when(F.col(g), g) for g in POPULATIONS)))
    g = s.select("score", "label", "n", "w", F.explode(member).alias("grp"))
    t = percentiles(s.filter(~label), "score", [0.99], weight="n").select(F.col("q")[0].alias("t"))
    enough = g.filter(~label).groupBy("grp").agg(F.sum("n").alias("n")).filter("n >= 20")
    q = percentiles(g.filter(~label), "score", [0.99], ["grp"], "n").join(enough, "grp", "left_semi").select("grp", F.col("q")[0].alias("q"))
    above = lambda c: F.try_divide(F.sum(F.when(~label & (F.col("score") > F.col(c)), F.col("n")).otherwise(0)), F.sum(F.when(~label & F.col("score").isNotNull(), F.col("n"))))
    m = g.join(F.broadcast(q), "grp").crossJoin(F.broadcast(t)).groupBy("grp").agg(above("t").alias("fpr"), (F.sum(F.when(label & (F.col("score") > F.col("q")), w)) / F.sum(F.when(label, w))).alias("tpr"))
    a = ranking.auc(g, "score", label, w, ["grp"]).select("grp", F.round("auc", 6).alias("auc_fw"))
    prec = F.col("tpr") / 66.0 / (F.col("tpr") / 66.0 + 0.01 * 65 / 66.0)
    return m.join(a, "grp").select("grp", "auc_fw", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr1_fw"), F.round(prec, 6).alias("prec65"))


@query("SELECT DISTINCT regexp_replace(lower(p_name), '[-_. ]+', '-', 'g') AS project FROM part")
def source_project_snapshot(spark, d):
    """The list of projects, written once to the shared folder and read from there."""
    return checkpointed(table(spark, d, "part").select(F.regexp_replace(F.lower("p_name"), "[-_. ]+", "-").alias("project")).distinct())


@query("SELECT p_partkey, p_name, p_size, 'bundle' AS kind, 7::BIGINT AS seed FROM part")
def sink_bundle_round_trip(spark, d):
    """A table and its settings, saved as a bundle and loaded again."""
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    save_bundle(spark, path, {"part": table(spark, d, "part").select("p_partkey", "p_name", "p_size")}, {"kind": "bundle", "seed": 7})
    tables, settings = load_bundle(spark, path)
    return tables["part"].select("*", F.lit(settings["kind"]).alias("kind"), F.lit(settings["seed"]).cast("bigint").alias("seed"))


@query("SELECT DISTINCT doc_id, md5(text) AS digest, length(text) AS size FROM documents WHERE doc_id IS NOT NULL")
def sink_artefact_cache(spark, d):
    """What is extracted from documents, half of it in an earlier run whose cache is used."""
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text")
    extract = lambda t: t.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("size"))
    cached(docs.filter("doc_id % 2 = 0"), "doc_id", path, extract)
    return cached(docs, "doc_id", path, extract)


@query("""SELECT unnest(['column p_partkey', 'column p_name', 'column p_rank', 'size above 0', 'name of two words', 'size below 10']) AS name,
unnest([0, 0, 1, count(*) FILTER (WHERE NOT coalesce(p_size > 0, false)), count(*) FILTER (WHERE NOT coalesce(p_name LIKE '% %', false)), count(*) FILTER (WHERE NOT coalesce(p_size < 10, false))])::BIGINT AS failed FROM part""")
def source_preflight(spark, d):
    """Checks before a job, some of which fail on purpose."""
    part = table(spark, d, "part")
    types = {"p_partkey": part.schema["p_partkey"].dataType, "p_name": T.StringType(), "p_rank": T.LongType()}
    return preflight(part, types, {"size above 0": F.col("p_size") > 0, "name of two words": F.col("p_name").like("% %"), "size below 10": F.col("p_size") < 10})
