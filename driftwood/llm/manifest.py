"""Merkle manifest of a table, by superblocks.

A row's leaf is the hash of its fields.  The leaves of a group (a source), in order of the key, are a tree of FANOUT; the
roots of the groups, in order, are another.  A superblock is a run of FANOUT^LEVELS nodes: one task collapses its LEVELS levels
and gives one root, and the roots are blocks again, until one is left.  Proofs go the other way: a block's upper proof is
made once, and the lower proofs of its nodes are put in front of it, so no level is written for every leaf.

A group of any size is dealt over its blocks.  Digests are lowercase hex, and are hashed as that text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import materialize, table
from driftwood.llm.ordering import numbered

#: Nodes under a node; levels that one task collapses.
FANOUT, LEVELS = 16, 3
_HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: list[Column]) -> Column:
    """The hash of the fields, each as UTF-8 byte count, colon and value; null is a dash."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _hash(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _collapsed(digests: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """The levels of a block whose tree has n nodes at the lowest: as many as there are up to the tree's root, at most levels."""
    out = [digests]
    for _ in range(levels):
        if n == 1:
            break
        last = out[-1]
        out.append([_hash(last[k : k + fanout]) for k in range(0, len(last), fanout)])
        n = -(-n // fanout)
    return out


def _proofs(levels: list[list[str]], above: str, fanout: int) -> list[str]:
    """For every node of the lowest level: its siblings, level by level, then the proof above the block."""
    proofs = [above]
    for nodes in reversed(levels[:-1]):
        proofs = ["".join(nodes[k // fanout * fanout : k] + nodes[k + 1 : k // fanout * fanout + fanout]) + proofs[k // fanout] for k in range(len(nodes))]
    return proofs


def fold(leaf: str, proof: str, places: list[tuple[int, int]], fanout: int = FANOUT) -> str:
    """The root that a leaf and its siblings give, by its (place, number of nodes) in each tree from the lowest on."""
    at = 0
    for i, n in places:
        while n > 1:
            run = min(fanout, n - i // fanout * fanout)
            siblings, own = proof[at : at + _HEX * (run - 1)], _HEX * (i % fanout)
            at += len(siblings)
            leaf = _hash([siblings[:own], leaf, siblings[own:]])
            i, n = i // fanout, -(-n // fanout)
    return leaf


def _superblocks(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """nodes(tree, i, n, digest) and, after each round, the roots of its blocks as nodes; the last has one node a tree."""
    size = fanout**levels

    def collapse(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i")
        n = int(block["n"].iloc[0])
        root = _collapsed(block["digest"].tolist(), n, fanout, levels)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "i": [key[1]], "n": [-(-n // size)], "digest": [root]})

    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or len(out) == 1:
        blocks = out[-1].select("tree", "i", "n", "digest").groupBy("tree", F.expr(f"i div {size}").alias("block"))
        out.append(materialize(blocks.applyInPandas(collapse, "tree long, i long, n long, digest string")))
        most = -(-most // size)
    return out


def _down(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, i, subroot, proof) of nodes, from above(tree, i, subroot, proof) of their blocks."""

    def extend(key: tuple, block: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i")
        made = _collapsed(block["digest"].tolist(), int(block["n"].iloc[0]), fanout, levels)
        return pd.DataFrame({"tree": block["tree"], "i": block["i"], "subroot": upper["subroot"].iloc[0], "proof": _proofs(made, upper["proof"].iloc[0], fanout)})

    lower = nodes.groupBy("tree", F.expr(f"i div {fanout**levels}").alias("block"))
    return lower.cogroup(above.groupBy("tree", F.col("i").alias("block"))).applyInPandas(extend, "tree long, i long, subroot string, proof string")


def manifest(docs: DataFrame, fields: list[str], group: str = "source", key: str = "doc_id", claimed: Column | None = None, proofs: bool = False, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, group_index, place, group_rows, groups, subroot, root, proof_sha256, folded_root) for every row of docs.

    Leaves of a group ascend by key, null first, and rows of one key by their leaf; groups ascend with null first.  claimed, a
    leaf to be verified in place of the row's own, gives folded_root with the row's siblings; without it the row's own leaf
    does.  proofs adds the proof itself: the siblings' digests, level by level, left to right.  No row gives no row.
    """
    leaf = leaf_hash([F.col(f) for f in fields])
    leaves = docs.select(F.col(key).alias("key"), F.col(group).alias("grp"), leaf.alias("digest"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    placed = numbered(leaves, ["grp"], [F.col("key").asc_nulls_first(), F.col("digest")])
    placed = materialize(placed.withColumnsRenamed({"place": "i", "rows": "n"}))
    groups = numbered(placed.select("grp").distinct(), [], [F.col("grp").asc_nulls_first()]).select(F.col("grp").alias("g_grp"), F.col("place").alias("tree"), F.col("rows").alias("trees"))
    nodes = materialize(placed.join(groups, F.col("grp").eqNullSafe(F.col("g_grp"))).select(F.col("key").cast("string").alias("key"), "tree", "trees", "i", "n", "digest", "claimed"))

    rounds = _superblocks(nodes, fanout, levels)
    tops = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.col("digest").alias("digest"))
    trees = nodes.select(F.first("trees").alias("n")).first()[0] if not nodes.isEmpty() else 0
    tops = _superblocks(tops.withColumn("n", F.lit(trees).cast("long")), fanout, levels)
    found = tops[-1].first()
    root = found["digest"] if found else None
    above = tops[-1].select("tree", "i", F.lit("").alias("subroot"), F.lit("").alias("proof"))
    for k in reversed(range(len(tops) - 1)):
        above = materialize(_down(tops[k], above, fanout, levels))
    above = above.select(F.col("i").alias("tree"), "proof").join(rounds[-1].select("tree", "i", F.col("digest").alias("subroot")), "tree").select("tree", "i", "subroot", "proof")
    for k in reversed(range(1, len(rounds) - 1)):
        above = materialize(_down(rounds[k], above, fanout, levels))

    def verify(key_: tuple, block: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i")
        n, (tree, trees) = int(block["n"].iloc[0]), (int(block["tree"].iloc[0]), int(block["trees"].iloc[0]))
        paths = _proofs(_collapsed(block["digest"].tolist(), n, fanout, levels), upper["proof"].iloc[0], fanout)
        stated = block["claimed"].where(block["claimed"].notna(), block["digest"])
        out = pd.DataFrame({"key": block["key"], "leaf": block["digest"], "group_index": block["tree"], "place": block["i"], "group_rows": block["n"], "groups": block["trees"], "subroot": upper["subroot"].iloc[0]})
        out["proof_sha256"] = [_hash([p]) for p in paths]
        out["folded_root"] = [fold(leaf, p, [(int(i), n), (tree, trees)], fanout) for leaf, p, i in zip(stated, paths, block["i"])]
        if proofs:
            out["proof"] = paths
        return out

    schema = "key string, leaf string, group_index long, place long, group_rows long, groups long, subroot string, proof_sha256 string, folded_root string" + (", proof string" if proofs else "")
    lower = nodes.groupBy("tree", F.expr(f"i div {fanout**levels}").alias("block"))
    out = lower.cogroup(above.groupBy("tree", F.col("i").alias("block"))).applyInPandas(verify, schema)
    # keys pass through pandas as text, where a null beside them can't make them floats
    return out.withColumns({"root": F.lit(root).cast("string"), "key": F.col("key").cast(docs.schema[key].dataType)}).withColumnRenamed("key", key)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root; a fifth of the documents are verified with the capitals of their text lowered."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = leaf_hash([F.translate("text", _UPPER, _LOWER) if f == "text" else F.col(f) for f in FIELDS])
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    out = manifest(docs, FIELDS, claimed=claimed)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL has for each of the two trees: sources of at most 16^LEVELS_SQL documents.
_DEPTH = 6


def _sql_tree(name: str, parts: str) -> str:
    """Levels of trees name0(parts, i, digest, n): name0 .. name_DEPTH, their siblings s, and the number of nodes m."""
    out = []
    for k in range(_DEPTH):
        out.append(
            f"{name}{k}s AS MATERIALIZED (SELECT {parts} i, digest, n, coalesce(string_agg(digest, '' ORDER BY i) OVER (PARTITION BY {parts} i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            f" coalesce(string_agg(digest, '' ORDER BY i) OVER (PARTITION BY {parts} i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),\n"
            f"{name}{k + 1} AS MATERIALIZED (SELECT {parts} i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest, (any_value(n) + 15) // 16 AS n FROM {name}{k} GROUP BY {parts} i // 16)"
        )
    return ",\n".join(out)


def _sql_fold() -> str:
    steps, last = [], "start"
    for tree, on, at in (("a", "x.g = t.g AND t.i = x.i // ", "i"), ("b", "t.i = x.g // ", "g")):
        for k in range(_DEPTH):
            steps.append(
                f"{tree}{k}f AS (SELECT x.* REPLACE (x.proof || t.l || t.r AS proof, CASE WHEN t.n = 1 THEN x.folded ELSE sha256(t.l || x.folded || t.r) END AS folded)"
                f" FROM {last} x JOIN {tree}{k}s t ON {on}{16**k})"
            )
            last = f"{tree}{k}f"
    return ",\n".join(steps)


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"


#: crc32 from its polynomial, over the digits of the id.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), list_transform(range(8), lambda z: z::UBIGINT)), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT)))"""

OP13_SQL = f"""
WITH hashed AS MATERIALIZED (SELECT doc_id, source, {_sql_leaf("text")} AS digest,
    CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 5 = 0 THEN {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS claimed FROM documents),
placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed),
a0 AS (SELECT g, i, digest, n FROM placed),
{_sql_tree("a", "g,")},
b0 AS MATERIALIZED (SELECT g AS i, digest, count(*) OVER () AS n FROM a{_DEPTH}),
{_sql_tree("b", "")},
start AS (SELECT doc_id, digest AS leaf, g, i, '' AS proof, coalesce(claimed, digest) AS folded FROM placed),
{_sql_fold()}
SELECT doc_id, leaf, a.digest AS subroot, b.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b.digest AS verified
FROM b{_DEPTH - 1}f x JOIN a{_DEPTH} a ON a.g = x.g CROSS JOIN b{_DEPTH} b
"""
