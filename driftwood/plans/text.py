"""Text, name, URL and file features over documents, pages, parts and events."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from driftwood.functions import scalars as fn
from driftwood.operators.scaling import binary_raw, log_standard, rescale_vectors, robust
from driftwood.plans.registry import query
from driftwood.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[-_. ]+', '-', 'g')) AS name, regexp_replace(lower(p_name), '[-_. ]', '', 'g') AS squashed, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS alnum FROM part")
def feat_normalise_name(spark, d):
    name = F.translate("p_name", " ", "_")
    return table(spark, d, "part").select("p_partkey", fn.normalise_name(name).alias("name"), fn.squash(name).alias("squashed"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "").alias("alnum"))


# What each capability looks like in source text.
CAPABILITIES = {
    "has_blob": r"[A-Za-z0-9+/]{200,}={0,2}",
    "has_dyn_exec": r"(?<![.\w])(?:exec|eval|compile)\s*\(",
    "has_builtins": r"getattr\s*\(\s*__builtins__|__import__\s*\(|globals\s*\(\s*\)\s*\[|__builtins__\s*\.\s*__dict__",
    "has_decode": r"b64decode|b32decode|b16decode|a85decode|b85decode|zlib\.decompress|marshal\.loads|codecs\.decode|bytes\.fromhex|lzma\.decompress|bz2\.decompress",
    "has_spawn": r"\bsubprocess\b|os\.system|os\.popen|os\.exec[lv]p?e?|\bPopen\b|os\.startfile",
    "has_network": r"(?m)^\s*(?:import|from)\s+(?:socket|urllib|urllib2|urllib3|requests|http\.client|httpx|aiohttp|ftplib|smtplib)\b",
    "has_platform": r"sys\.platform|os\.name|platform\.system",
}


def sql_pattern(p: str) -> str:
    """A pattern for DuckDB, which has no look-behind and whose word boundaries know ASCII only; good for a yes or no."""
    p = p.replace("(?iU)", "(?i)").replace(r"(?<![.\w])", r"(?:^|[^.\pL\pN_])")
    p = re.sub(r"\\b(?=[A-Za-z])", r"(?:^|[^\\pL\\pN_])", p)
    return p.replace(r"\b", r"(?:$|[^\pL\pN_])")


def spark_pattern(p: str) -> str:
    """The same answer, with a run of many characters entered at its start only."""
    return p.replace("[A-Za-z0-9+/]{200,}={0,2}", "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{200}")


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{sql_pattern(p)}')::INT AS {k}" for k, p in CAPABILITIES.items()) + " FROM documents")
def feat_capability_flags(spark, d):
    return docs(spark, d).select("doc_id", *(F.col("text").rlike(spark_pattern(p)).cast("int").alias(k) for k, p in CAPABILITIES.items()))


@query("""WITH l AS (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS ls FROM documents)
SELECT doc_id, list_max([length(x) for x in ls]) AS max_line, len([x for x in ls if length(x) > 1000]) AS long_lines, len(ls) AS n_lines FROM l""")
def feat_line_metrics(spark, d):
    ls = fn.lines(F.col("text"))
    return docs(spark, d).select("doc_id", fn.max_line_length(F.col("text")).cast("bigint").alias("max_line"), F.size(F.filter(ls, lambda x: F.length(x) > 1000)).cast("bigint").alias("long_lines"), F.size(ls).cast("bigint").alias("n_lines"))


@query("""WITH c AS (SELECT page_id, pos, CASE WHEN c IN ('(', '[', '{') THEN 1 ELSE -1 END AS v FROM (SELECT page_id, unnest(string_split(regexp_replace(html, '[^()\\[\\]{}]', '', 'g'), '')) AS c, generate_subscripts(string_split(regexp_replace(html, '[^()\\[\\]{}]', '', 'g'), ''), 1) AS pos FROM pages) WHERE c <> ''),
s AS (SELECT page_id, pos, sum(v) OVER w AS p FROM c WINDOW w AS (PARTITION BY page_id ORDER BY pos)), m AS (SELECT page_id, p - least(0, min(p) OVER (PARTITION BY page_id ORDER BY pos)) AS depth FROM s)
SELECT pages.page_id, coalesce(max(depth), 0)::BIGINT AS depth FROM pages LEFT JOIN m USING (page_id) GROUP BY 1""")
def feat_nesting_depth(spark, d):
    return table(spark, d, "pages").select("page_id", fn.nesting_depth(F.col("html")).cast("bigint").alias("depth"))


@query("""SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[A-Za-z0-9\\s]', '', 'g')) / length(text) ELSE 0 END, 6) AS symbol_ratio,
round(CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, '>>', ''))) / length(text) ELSE 0 END, 6) AS shift_density FROM documents""")
def feat_symbol_ratio(spark, d):
    t = F.col("text")
    shift = F.when(F.length(t) > 0, (F.length(t) - F.length(F.replace(t, F.lit(">>"), F.lit("")))) / F.length(t)).otherwise(0.0)
    return docs(spark, d).select("doc_id", F.round(fn.symbol_ratio(t), 6).alias("symbol_ratio"), F.round(shift, 6).alias("shift_density"))


@query("""SELECT doc_id, coalesce(list_max([length(x) - 2 for x in regexp_extract_all(text, '''[^''\n]*''|"[^"\n]*"')]), 0) AS longest FROM documents""")
def feat_longest_literal(spark, d):
    return docs(spark, d).select("doc_id", fn.longest_literal(F.col("text")).cast("bigint").alias("longest"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9+/=]{200,}', '<BLOB>', 'g'), '\\s+', '', 'g')) AS fingerprint FROM documents")
def feat_fingerprint(spark, d):
    return docs(spark, d).select("doc_id", fn.fingerprint(F.col("text")).alias("fingerprint"))


def document_shingles(df, size: int = 9, shortest: int = 500):
    """(doc_id, n, least): number and least of the distinct shingles of each whole text, null for shorter texts."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            n, least = [], []
            for text in b.column("text").to_pylist():
                found = {text[i : i + size] for i in range(len(text) - size + 1)} if text is not None and len(text) >= max(shortest, size) else None
                n.append(found and len(found))
                least.append(found and min(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(least, pa.string())], ["doc_id", "n", "least"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, least string")


@query()
def feat_document_shingles(spark, d):
    """The shingles of the documents (feat_shingles has those of URLs, which its SQL fixes)."""
    return document_shingles(docs(spark, d))


@query("""WITH s AS (SELECT page_id, url AS t FROM pages) SELECT page_id, len(list_distinct([substr(t, i, 9) for i in range(1, length(t) - 7)])) AS n, list_min([substr(t, i, 9) for i in range(1, length(t) - 7)]) AS least FROM s""")
def feat_shingles(spark, d):
    s = fn.shingles(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.size(s).cast("bigint").alias("n"), F.array_min(s).alias("least"))


MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '{MAIL}'))) AS mails, list_sort(list_distinct([sha1(x) for x in regexp_extract_all(text, '[0-9a-f]{{32,}}')])) AS blobs FROM documents""")
def feat_extract_artifacts(spark, d):
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    return docs(spark, d).select("doc_id", F.array_sort(F.array_distinct(found(MAIL))).alias("mails"), F.array_sort(F.array_distinct(F.transform(found("[0-9a-f]{32,}"), F.sha1))).alias("blobs"))


#: Signs that a release was made for research or a test.
# Signs of research, of call-backs, of contests and of tests, with classes of Unicode.
FULL_NOISE = {
    "research": r"(?iU)proof[\s_-]*of[\s_-]*concept|\bpoc\b|security[\s_-]*research|bug[\s_-]*bounty|hackerone|bugcrowd|"
    r"intigriti|yeswehack|dependency[\s_-]*confusion|research[\s_-]*purpose|for[\s_-]*research|"
    r"penetration[\s_-]*test|\bpentest|red[\s_-]*team|security[\s_-]*test|vulnerability[\s_-]*research|"
    r"responsible[\s_-]*disclosure|do[\s_-]*not[\s_-]*(install|use)|this[\s_-]*package[\s_-]*is[\s_-]*(a[\s_-]*)?"
    r"(test|placeholder|security)|harmless|benign",
    "callback": r"(?iU)burpcollaborator\.net|oastify\.com|interact\.sh|\boast\.(pro|live|site|online|fun|me)\b|canarytokens|"
    r"dnslog\.cn|ceye\.io|requestbin|pipedream\.net|webhook\.site|beeceptor|requestcatcher|hookbin|"
    r"ngrok\.io|interactsh",
    "ctf": r"(?iU)\bctf\b|capture[\s_-]*the[\s_-]*flag|flag\{",
    "test_word": r"(?iU)\btest(ing)?\b",
}
TEST_NAME = r"(?iU)^(test|testing|demo|poc|hello|helloworld|example|dummy|sample)([-_.]|$)|[-_.](test|poc|demo)$"


#: What a text that matches has, in lower case: one of these words for each pattern.  The alternative that starts with "do not" has words
#: that many texts have and is looked for by itself.
DO_NOT = r"do[\s_-]*not[\s_-]*(install|use)|"
NOISE_WORDS = {
    "research": "proof poc security bounty hackerone bugcrowd intigriti yeswehack confusion research penetration pentest team disclosure package harmless benign".split(),
    "callback": "burpcollaborator oastify interact oast. canarytokens dnslog ceye requestbin pipedream webhook beeceptor requestcatcher hookbin ngrok".split(),
    "ctf": ["ctf", "flag"],
    "test_word": ["test"],
}
#: Letters that count as k, s and i where case is ignored.
FOLDED = "\u212a\u017f\u0131\u0130"


def noise_flags(t, low):
    """Whether a text t, low in lower case, matches each of the patterns; these are tried only where one of their words is there."""
    some = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    folded = reduce(lambda a, b: a | b, (F.contains(t, F.lit(c)) for c in FOLDED))
    out = {k: (some(NOISE_WORDS[k]) | folded) & t.rlike(p.replace(DO_NOT, "")) for k, p in FULL_NOISE.items()}
    out["research"] = out["research"] | (some(["not"]) | folded) & t.rlike("(?iU)" + DO_NOT.rstrip("|"))
    return out


def noise_matches(df):
    """For each of df(doc_id, text) which patterns it matches, each with a snippet around its own first match ("" without one).

    The first word of a text plays the name of the release.
    """
    df = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    t, out = F.col("text"), []
    for k, hit in noise_flags(t, F.col("low")).items():
        p = FULL_NOISE[k]
        start, size = F.length(F.element_at(F.split(t, p, 2), 1)), F.length(F.regexp_extract(t, p, 0))
        first = F.greatest(F.lit(0), start - 60)
        around = F.left(F.regexp_replace(F.substring(t, first + 1, start + size + 60 - first), r"(?U)\s+", " "), F.lit(160))
        out += [hit.alias(k), F.when(hit, around).otherwise("").alias(f"{k}_match")]
    return df.select("doc_id", *out, F.regexp_extract(t, r"^\s*(\S*)", 1).rlike(TEST_NAME).alias("test_name"))


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), '{sql_pattern(p)}') AS {k}" for k, p in FULL_NOISE.items()) + " FROM documents")
def feat_noise_patterns(spark, d):
    """The patterns alone, for every document."""
    return noise_matches(docs(spark, d)).select("doc_id", *FULL_NOISE)


@query()
def feat_noise_matches(spark, d):
    """The label-noise patterns over all documents, with snippets and the name's own (feat_noise_patterns has what SQL says too)."""
    return noise_matches(docs(spark, d))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host,
regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages WHERE NOT regexp_matches(url, '://(localhost|127\\.)')""")
def feat_link_host(spark, d):
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return table(spark, d, "pages").filter(~F.col("url").rlike(r"://(localhost|127\.)")).select("page_id", host.alias("host"), path.alias("path"))


@query("""WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, 'py-' || split_part(p_name, ' ', 2) || '.git' AS repo FROM part),
n AS (SELECT p_partkey, a, regexp_replace(regexp_replace(repo, '\\.git$', ''), '^(py|python)-|-(py|python)$', '', 'g') AS r FROM w) SELECT p_partkey, a = r AS same, contains(r, a) OR contains(a, r) AS within FROM n""")
def feat_repo_match(spark, d):
    repo = F.concat(F.lit("py-"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(".git"))
    r = F.regexp_replace(F.regexp_replace(repo, r"\.git$", ""), "^(py|python)-|-(py|python)$", "")
    n = table(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), r.alias("r"))
    return n.select("p_partkey", (F.col("a") == F.col("r")).alias("same"), (F.contains("r", "a") | F.contains("a", "r")).alias("within"))


@query("""WITH l AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN split_part(p_name, ' ', 1) || '>=1.' || p_size WHEN 2 THEN '-r ' || p_name WHEN 3 THEN 'git+https://x/' || p_brand ELSE split_part(p_name, ' ', 1) || '_' || split_part(p_name, ' ', 2) || '[extra]==2 # pin' END AS line FROM part),
b AS (SELECT p_partkey, trim(regexp_replace(line, '(^|\\s)#.*$', '')) AS bare FROM l)
SELECT p_partkey, CASE WHEN regexp_matches(bare, '^-|://') OR NOT regexp_matches(bare, '^[A-Za-z0-9]') THEN NULL ELSE lower(regexp_replace(regexp_replace(regexp_extract(bare, '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1), '[-_.]+$', ''), '[-_.]+', '-', 'g')) END AS name FROM b""")
def feat_requirement_name(spark, d):
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, F.concat(F.lit("# "), "p_name")).when(k == 1, F.concat(first, F.lit(">=1."), F.col("p_size").cast("string"))).when(k == 2, F.concat(F.lit("-r "), "p_name"))
    line = line.when(k == 3, F.concat(F.lit("git+https://x/"), "p_brand")).otherwise(F.concat(first, F.lit("_"), second, F.lit("[extra]==2 # pin")))
    return table(spark, d, "part").select("p_partkey", fn.requirement_name(line).alias("name"))


@query("""SELECT page_id, contains(html, '<script') AND NOT contains(html, 'noscript') AS has_script, length(html) AS size, regexp_matches(url, '\\.html$') AS top_file,
round(length(html) / greatest(length(url), 1), 4) AS ratio, len(regexp_extract_all(html, '<a ')) AS n_links FROM pages""")
def feat_file_shape(spark, d):
    """Build-file flags, sizes and ratios of a page that plays an archive."""
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", (F.contains(h, F.lit("<script")) & ~F.contains(h, F.lit("noscript"))).alias("has_script"), F.length(h).cast("bigint").alias("size"), F.col("url").rlike(r"\.html$").alias("top_file"),
        F.round(F.length(h) / F.greatest(F.length("url"), F.lit(1)), 4).alias("ratio"), F.regexp_count(h, F.lit("<a ")).cast("bigint").alias("n_links"),
    )


@query("""WITH w AS (SELECT doc_id, list_distinct([lower(x) for x in regexp_extract_all(text, '\\b(?:of|with) ([A-Za-z]+)', 1)]) AS names FROM documents) SELECT doc_id, len(names) AS n, list_sort(names)[:4] AS first_names FROM w""")
def feat_import_names(spark, d):
    """Names after a keyword, as imports are found after theirs."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\b(?:of|with) ([A-Za-z]+)"), F.lit(1)), F.lower))
    return docs(spark, d).select("doc_id", F.size(names).cast("bigint").alias("n"), F.slice(F.array_sort(names), 1, 4).alias("first_names"))


@query("""WITH dep AS (SELECT l_orderkey AS path, l_partkey AS dep, l_linenumber % 2 AS optional, 'f' || l_linenumber AS source FROM lineitem WHERE l_partkey <> l_orderkey),
m AS (SELECT path, dep, min(optional) AS optional, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM dep GROUP BY ALL)
SELECT o_orderkey AS path, count(*) FILTER (WHERE optional = 0) AS n_core, count(*) FILTER (WHERE optional = 1) AS n_optional,
 CASE WHEN count(dep) > 0 THEN 'found' WHEN any_value(o_orderstatus) = 'P' THEN 'dynamic' WHEN any_value(o_orderstatus) = 'F' THEN 'none_declared' ELSE 'no_declaration_files' END AS status
FROM orders LEFT JOIN m ON path = o_orderkey GROUP BY 1""")
def feat_dependency_merge(spark, d):
    """Core anywhere beats optional; a status for releases without dependencies."""
    dep = table(spark, d, "lineitem").filter("l_partkey <> l_orderkey").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("dep"), (F.col("l_linenumber") % 2).alias("optional"))
    merged = dep.groupBy("path", "dep").agg(F.min("optional").alias("optional"))
    by_path = merged.groupBy("path").agg(F.count_if(F.col("optional") == 0).alias("n_core"), F.count_if(F.col("optional") == 1).alias("n_optional"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus").join(by_path, "path", "left").na.fill(0)
    status = F.when(F.col("n_core") + F.col("n_optional") > 0, "found").when(F.col("o_orderstatus") == "P", "dynamic").when(F.col("o_orderstatus") == "F", "none_declared").otherwise("no_declaration_files")
    return o.select("path", "n_core", "n_optional", status.alias("status"))


COLUMNS = ["p_size", "p_retailprice", "is_brass"]
PARTS = "p AS (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice, contains(p_type, 'BRASS')::INT::DOUBLE AS is_brass, p_partkey % 3 <> 0 AS fit FROM part)"


def parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.contains("p_type", F.lit("BRASS")).cast("double").alias("is_brass"), (F.col("p_partkey") % 3 != 0).alias("fit"))


def _rounded(df, *columns):
    return df.select("p_partkey", *(F.round(c, 6).alias(c) for c in columns))


@query(f"WITH {PARTS} SELECT p_partkey, is_brass, " + ", ".join(f"round((ln(1 + {c}) - (SELECT avg(ln(1 + {c})) FROM p WHERE fit)) / (SELECT stddev_pop(ln(1 + {c})) FROM p WHERE fit), 6) AS {c}" for c in COLUMNS[:2]) + " FROM p")
def scale_log_standard(spark, d):
    return _rounded(log_standard(parts(spark, d), COLUMNS, F.col("fit")), *COLUMNS)


@query(f"WITH {PARTS}, q AS (SELECT " + ", ".join(f"median({c}) AS m{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i{c}" for c in COLUMNS) + " FROM p WHERE fit) SELECT p_partkey, " + ", ".join(f"round(({c} - m{c}) / (CASE WHEN i{c} = 0 THEN 1 ELSE i{c} / 1.349 END), 6) AS {c}" for c in COLUMNS) + " FROM p, q")
def scale_robust(spark, d):
    return _rounded(robust(parts(spark, d), COLUMNS, F.col("fit")), *COLUMNS)


@query(f"WITH {PARTS} SELECT p_partkey, is_brass, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM p WHERE fit)) / (SELECT stddev_pop({c}) FROM p WHERE fit), 6) AS {c}" for c in COLUMNS[:2]) + " FROM p")
def scale_binary_raw(spark, d):
    return _rounded(binary_raw(parts(spark, d), COLUMNS, F.col("fit")), *COLUMNS)


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT k, avg(v) AS m, stddev_samp(v) AS s FROM x GROUP BY 1)
SELECT vec_id, round(sum((v - m) / s * k), 5) AS weighted FROM x JOIN s USING (k) GROUP BY 1""")
def scale_rescale_all(spark, d):
    scaled = rescale_vectors(table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding")), "embedding")
    weighted = F.aggregate(F.transform("embedding", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return scaled.select("vec_id", F.round(weighted, 5).alias("weighted"))
