"""Column expressions: hashes to the unit interval, names, text measures and numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO60 = 1152921504606846976.0


def u01(key: Column) -> Column:
    """Uniform in [0, 1): the first 60 bits of sha-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 15), 16, 10).cast("bigint") / F.lit(TWO60)


def split_of(u: Column, train: float = 0.5, val: float = 0.7) -> Column:
    return F.when(u < train, "train").when(u < val, "val").otherwise("test")


def right_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval (edges[i], edges[i+1]] that holds x; null outside."""
    out = F.when(x <= edges[0], F.lit(None))
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(x <= edge, label)
    return out


def is_close(x: Column, y: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(x - F.lit(y)) <= atol + rtol * abs(y)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def normalise_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def squash(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_.]", "")


def clean_unknown(x: Column) -> Column:
    return F.when(F.lower(F.trim(x)).isin("unknown", "none", ""), "").otherwise(F.trim(x))


def requirement_name(line: Column) -> Column:
    """The project name of a requirement line; null for comments, options and URLs."""
    bare = F.trim(F.regexp_replace(line, r"(^|\s)#.*$", ""))
    name = F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.when(bare.rlike(r"^-|://") | (name == ""), F.lit(None)).otherwise(normalise_name(F.regexp_replace(name, "[-_.]+$", "")))


def symbol_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits nor white space (ASCII classes)."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[A-Za-z0-9\s]", "")) / n).otherwise(0.0)


def lines(text: Column) -> Column:
    """Lines between \\n; a trailing empty line does not count."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def max_line_length(text: Column) -> Column:
    return F.array_max(F.transform(lines(text), F.length))


def nesting_depth(text: Column) -> Column:
    """Deepest bracket nesting, the depth never falling below 0."""
    brackets = F.split(F.regexp_replace(text, r"[^()\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, c: Column) -> Column:
        d = F.when(c.isin("(", "[", "{"), acc["d"] + 1).when(c.isin(")", "]", "}"), F.greatest(acc["d"] - 1, F.lit(0))).otherwise(acc["d"])
        return F.struct(d.alias("d"), F.greatest(acc["m"], d).alias("m"))

    return F.aggregate(brackets, start, step)["m"]


def longest_literal(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("'[^'\\n]*'|\"[^\"\\n]*\""), F.lit(0))
    return F.coalesce(F.array_max(F.transform(found, lambda s: F.length(s) - 2)), F.lit(0))


def shingles(text: Column, n: int = 9) -> Column:
    """Distinct windows of n characters; none for shorter texts."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def code_normalised(text: Column) -> Column:
    """Long base-64 runs become <BLOB>, white space goes."""
    return F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9+/=]{200,}", "<BLOB>"), r"\s+", "")


def fingerprint(text: Column) -> Column:
    return F.sha2(code_normalised(text), 256)


def precision_at_base_rate(tpr: Column, fpr: float, per: int) -> Column:
    """Precision when one release in 1 + per is positive."""
    p = 1 / (1 + per)
    return tpr * p / (tpr * p + fpr * (1 - p))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def contamination_size(level: float, normal: Column) -> Column:
    """Positives to add so that they are a share level of the whole (half to even)."""
    return F.bround(F.lit(level) * normal / (1 - level)).cast("bigint")


#: The version scheme of PEP 440 (its appendix B), in lower case; fixed values.
PEP440 = (
    r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
#: A requirement of PEP 508: name, extras, then an address or version clauses, then a marker.
PEP508 = r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[([^\]]*)\])?\s*(?:@\s*([^\s;]+)|\(?\s*((?:(?:===|~=|==|!=|<=|>=|<|>)\s*[^\s,;()]+\s*,?\s*)*)\)?)\s*(?:;\s*(.*))?$"


def _whole(digits: Column) -> Column:
    """Digits without leading zeros; none at all are 0."""
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def version(text: Column) -> Column:
    """The normal form of a version by PEP 440; of any other text separators become dots, letters lower case, and a leading v goes."""
    v = F.lower(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")))
    part = lambda k: F.regexp_extract(v, PEP440, k)
    release = F.array_join(F.transform(F.split(part(2), r"\."), _whole), ".")
    epoch = F.when(F.ltrim(part(1), F.lit("0")) != "", F.concat(_whole(part(1)), F.lit("!"))).otherwise("")
    pre = F.when(part(3) == "", "").otherwise(F.concat(F.when(part(3).isin("alpha", "a"), "a").when(part(3).isin("beta", "b"), "b").otherwise("rc"), _whole(part(4))))
    post = F.when(part(5) != "", F.concat(F.lit(".post"), _whole(part(5)))).when(part(6) != "", F.concat(F.lit(".post"), _whole(part(7)))).otherwise("")
    dev = F.when(part(8) != "", F.concat(F.lit(".dev"), _whole(part(9)))).otherwise("")
    piece = lambda p: F.when(p.rlike("^[0-9]+$"), _whole(p)).otherwise(p)
    local = F.when(part(10) == "", "").otherwise(F.concat(F.lit("+"), F.array_join(F.transform(F.split(part(10), "[-_.]"), piece), ".")))
    other = F.ltrim(F.lower(F.regexp_replace(text, "[-_.]+", ".")), F.lit("v"))
    return F.when(v.rlike(PEP440), F.concat(epoch, release, pre, post, dev, local)).otherwise(other)


def requirement_parts(line: Column) -> Column:
    """struct(name, extras, url, clauses, marker, optional) of a requirement line by PEP 508; null for comments, options, bare addresses and broken lines.

    Names are normal, extras sorted, clauses without blanks and sorted; optional is whether the marker asks for an extra.
    """
    bare = F.trim(F.regexp_replace(line, r"(^|\s)#.*$", ""))
    part = lambda k: F.regexp_extract(bare, PEP508, k)
    listed = lambda c: F.array_join(F.array_sort(F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_replace(x, r"\s", "")), lambda x: x != "")), ",")
    found = F.struct(
        normalise_name(part(1)).alias("name"), F.lower(listed(part(2))).alias("extras"), part(3).alias("url"), listed(part(4)).alias("clauses"), F.trim(part(5)).alias("marker"),
        part(5).rlike(r"\bextra\s*==").alias("optional"),
    )
    return F.when(bare.rlike(PEP508) & ~bare.rlike("^(-|git\\+|https?:|file:)"), found)
