"""Versions and requirements by their public grammars, over strings put together from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.functions import scalars as fn
from driftwood.plans.registry import query
from driftwood.sources.tables import table

#: Forms of a version made of a part's size {s} and key {k}, accepted and refused ones.
FORMS = ["{s}.{k}", "v{s}.0{k}", "1!{s}.{k}.0", "{s}.{k}-alpha.1", "{s}.{k}_Beta2", "{s}.{k}RC", "{s}.{k}-3", "{s}.{k}.rev07", "{s}.{k}.dev", "{s}.{k}a1.post2.DEV03+Local-01_x", "0!{s}.{k}preview4", " {s}.{k}.post ", "v{s}__{k}", "{s}.{k}-final", "release-{s}", "{s}..{k}", "V.{k}"]
#: Forms of a requirement line.
LINES = [
    "Part_{k}", "part.{k} >= {s}, <{k}", "Part-{k}[Extra_B, a] ~={s}.0 ; python_version < '3.9'", "part{k} @ https://example.org/{k}.zip ; extra == 'test'", "part{k} (=={s}.*)", "# part{k}", "-r part{k}.txt",
    "git+https://example.org/part{k}", "part{k}; extra=='docs' and os_name == 'nt'", "part{k}>={s} # why", "!part{k}", "part{k} => 3", "",
]


def _made(forms):
    """The form that a part's key picks, filled in."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    return F.replace(F.replace(form, F.lit("{k}"), k), F.lit("{s}"), s)


def _sql_list(forms):
    return "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in forms) + "]"


def _sql_made(forms):
    return f"replace(replace({_sql_list(forms)}[p_partkey % {len(forms)} + 1], '{{k}}', p_partkey::VARCHAR), '{{s}}', p_size::VARCHAR)"


_N = "CASE WHEN ltrim({0}, '0') = '' THEN '0' ELSE ltrim({0}, '0') END"
_G = "'" + fn.PEP440 + "'"
VERSION_SQL = f"""WITH m AS (SELECT p_partkey AS id, {_sql_made(FORMS)} AS raw FROM part), v AS (SELECT *, lower(trim(raw)) AS v FROM m),
g AS (SELECT *, regexp_matches(v, {_G}) AS ok, {", ".join(f"regexp_extract(v, {_G}, {k}) AS g{k}" for k in range(1, 10))}, regexp_extract(v, '\\+(.*)$', 1) AS g10 FROM v)
SELECT id, raw, CASE WHEN NOT ok THEN ltrim(lower(regexp_replace(raw, '[-_.]+', '.', 'g')), 'v') ELSE
  CASE WHEN ltrim(g1, '0') <> '' THEN ltrim(g1, '0') || '!' ELSE '' END || array_to_string(list_transform(string_split(g2, '.'), lambda x: {_N.format("x")}), '.')
  || CASE WHEN g3 = '' THEN '' ELSE CASE WHEN g3 IN ('alpha', 'a') THEN 'a' WHEN g3 IN ('beta', 'b') THEN 'b' ELSE 'rc' END || {_N.format("g4")} END
  || CASE WHEN g5 <> '' THEN '.post' || {_N.format("g5")} WHEN g6 <> '' THEN '.post' || {_N.format("g7")} ELSE '' END || CASE WHEN g8 <> '' THEN '.dev' || {_N.format("g9")} ELSE '' END
  || CASE WHEN g10 = '' THEN '' ELSE '+' || array_to_string(list_transform(regexp_split_to_array(g10, '[-_.]'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN {_N.format("x")} ELSE x END), '.') END END AS version FROM g"""


@query(VERSION_SQL)
def feat_version_grammar(spark, d):
    """Normal forms of versions, and the fallback for what the grammar refuses."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), _made(FORMS).alias("raw")).withColumn("version", fn.version(F.col("raw")))


_R = "'" + fn.PEP508.replace("'", "''") + "'"
_LISTED = "array_to_string(list_sort(list_filter(list_transform(string_split({0}, ','), lambda x: regexp_replace(x, '\\s', '', 'g')), lambda x: x <> '')), ',')"
REQUIREMENT_SQL = rf"""WITH m AS (SELECT p_partkey AS id, {_sql_made(LINES)} AS line FROM part), b AS (SELECT *, trim(regexp_replace(line, '(^|\s)#.*$', '', 'g')) AS bare FROM m),
g AS (SELECT *, {", ".join(f"regexp_extract(bare, {_R}, {k}) AS g{k}" for k in range(1, 6))} FROM b WHERE regexp_matches(bare, {_R}) AND NOT regexp_matches(bare, '^(-|git\+|https?:|file:)'))
SELECT m.id, line, lower(regexp_replace(g1, '[-_.]+', '-', 'g')) AS name, lower({_LISTED.format("g2")}) AS extras, g3 AS url, {_LISTED.format("g4")} AS clauses, trim(g5) AS marker, regexp_matches(g5, '\bextra\s*==') AS optional
FROM m LEFT JOIN g USING (id, line)"""


@query(REQUIREMENT_SQL)
def feat_requirement_grammar(spark, d):
    """Names, extras, addresses, version clauses and markers of requirement lines; nulls where a line is none."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), _made(LINES).alias("line")).withColumn("r", fn.requirement_parts(F.col("line")))
    return rows.select("id", "line", "r.*")
