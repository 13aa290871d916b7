"""Release archives, read as bytes in memory and never executed: files, texts, declared dependencies and metadata."""

from __future__ import annotations

import ast
import configparser
import email.parser
import io
import re
import tarfile
import tomllib
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read of one file and of one archive.
FILE_BYTES, ARCHIVE_BYTES = 5 << 20, 50 << 20
SUFFIXES = (".tar.gz", ".tgz", ".zip", ".whl", ".tar.bz2")
WANTED = re.compile(r"(?:^|/)(?:[^/]*\.py|PKG-INFO|METADATA|requires\.txt|setup\.cfg|pyproject\.toml|requirements[^/]*\.txt)$")


def archives(spark: SparkSession, root: str) -> DataFrame:
    """(name, version, path, content) of archives at <root>/<name>/<version>/<file>; dot folders are skipped, a missing version is "unknown"."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rest = F.split(F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/').removeprefix('file:'))}/", ""), "/")
    keep = F.col("path").rlike("(?:" + "|".join(re.escape(s) for s in SUFFIXES) + ")$") & ~F.exists(rest, lambda p: F.startswith(p, F.lit(".")))
    return files.filter(keep).select(F.element_at(rest, 1).alias("name"), F.when(F.size(rest) >= 3, F.element_at(rest, 2)).otherwise("unknown").alias("version"), "path", "content")


def members(content: bytes):
    """(name, size, reader) of the regular files of an archive."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        z = zipfile.ZipFile(io.BytesIO(content))
        for i in z.infolist():
            if not i.is_dir():
                yield i.filename, i.file_size, lambda i=i: z.open(i).read(FILE_BYTES)
    else:
        t = tarfile.open(fileobj=io.BytesIO(content))
        for m in t:
            if m.isfile():
                yield m.name, m.size, lambda m=m: t.extractfile(m).read(FILE_BYTES)


def read(content: bytes) -> tuple[list[tuple[str, int]], dict[str, str], bool]:
    """All file names and sizes, the texts of wanted files, and whether a limit cut anything off."""
    files, texts, used, cut = [], {}, 0, False
    for name, size, get in members(content):
        files.append((name, size))
        if WANTED.search(name):
            if size > FILE_BYTES or used + size > ARCHIVE_BYTES:
                cut = True
            if used + min(size, FILE_BYTES) <= ARCHIVE_BYTES:
                data = get()
                used += len(data)
                texts[name] = data.decode("utf-8", "replace")
    return files, texts, cut


def requirement(line: str) -> str | None:
    """Normalised project name of a requirement line; None for comments, options and URLs."""
    line = re.sub(r"(^|\s)#.*$", "", line).strip()
    if line.startswith("-") or "://" in line.split("@")[0]:
        return None
    found = re.match(r"[A-Za-z0-9][A-Za-z0-9._-]*", line)
    return re.sub(r"[-_.]+", "-", found[0].rstrip("-_.")).lower() if found else None


def _setup_py(text: str):
    """install_requires and extras_require of a setup() call, where they are literals; the code is parsed, not run."""
    dynamic, out = False, []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Call) and getattr(node.func, "id", getattr(node.func, "attr", "")) == "setup":
            for k in node.keywords:
                if k.arg in ("install_requires", "extras_require"):
                    try:
                        value = ast.literal_eval(k.value)
                    except ValueError:
                        dynamic = True
                        continue
                    if isinstance(value, dict):
                        out += [(x, 1) for v in value.values() for x in ([v] if isinstance(v, str) else v)]
                    else:
                        out += [(x, 0) for x in ([value] if isinstance(value, str) else value)]
    return out, dynamic


def declared(texts: dict[str, str]) -> tuple[list[tuple[str, int, str]], str]:
    """(name, optional, source) of every declared dependency, and a status."""
    out, dynamic, files = [], False, 0
    for path, text in sorted(texts.items()):
        base = path.rsplit("/", 1)[-1]
        lines: list[tuple[str, int]] = []
        try:
            if base in ("PKG-INFO", "METADATA"):
                for v in email.parser.HeaderParser().parsestr(text).get_all("Requires-Dist") or []:
                    lines.append((v, int("extra ==" in v or "extra==" in v)))
            elif base == "requires.txt":
                optional = 0
                for x in text.splitlines():
                    if x.startswith("["):
                        optional = int(not x.startswith("[:"))
                    else:
                        lines.append((x, optional))
            elif base == "setup.py" and path.count("/") <= 1:
                lines, dyn = _setup_py(text)
                dynamic |= dyn
            elif base == "setup.cfg" and path.count("/") <= 1:
                c = configparser.ConfigParser()
                c.read_string(text)
                lines += [(x, 0) for x in c.get("options", "install_requires", fallback="").splitlines()]
                if c.has_section("options.extras_require"):
                    lines += [(x, 1) for _, v in c.items("options.extras_require") for x in v.splitlines()]
            elif base == "pyproject.toml" and path.count("/") <= 1:
                p = tomllib.loads(text).get("project", {})
                dynamic |= "dependencies" in p.get("dynamic", [])
                lines += [(x, 0) for x in p.get("dependencies", [])] + [(x, 1) for v in p.get("optional-dependencies", {}).values() for x in v]
            elif base.startswith("requirements") and path.count("/") <= 1:
                lines += [(x, 0) for x in text.splitlines()]
            else:
                continue
        except (SyntaxError, ValueError, configparser.Error):
            continue
        files += 1
        out += [(name, optional, base) for x, optional in lines if (name := requirement(x))]
    return out, "found" if out else "dynamic" if dynamic else "none_declared" if files else "no_declaration_files"


def metadata(text: str) -> dict[str, int]:
    """Flags and counts of an e-mail-style header block."""
    h = email.parser.HeaderParser().parsestr(text)
    clean = lambda v: "" if (v or "").strip().lower() in ("unknown", "none", "") else v.strip()
    links = [x.lower() for x in (h.get_all("Project-URL") or []) + [clean(h.get("Home-page")), clean(h.get("Download-URL"))] if x]
    words = lambda v: {w for w in re.split(r"[^a-z0-9]+", (v or "").lower()) if len(w) >= 3}
    owners = {m[1] for x in links if (m := re.search(r"(?:github|gitlab)\.com/([a-z0-9_-]+)", x))}
    authors = words(clean(h.get("Author"))) | words(clean(h.get("Author-email")).split("@")[0])
    return {
        "has_pkg_info": 1, "link_count": len(links), "has_source_repo": int(any(re.search("github|gitlab|bitbucket|source", x) for x in links)), "has_homepage": int(bool(clean(h.get("Home-page")))),
        "has_issue_tracker": int(any(re.search("issue|tracker|bug", x) for x in links)), "has_documentation": int(any(re.search("doc", x) for x in links)), "has_license": int(bool(clean(h.get("License")))),
        "has_description": int(bool(clean(h.get("Summary")) or (h.get_payload() or "").strip())), "description_length": len((h.get_payload() or "").strip()), "classifier_count": len(h.get_all("Classifier") or []),
        "author_repo_defined": int(bool(owners and authors)), "author_repo_consistency": int(any(words(o) & authors for o in owners)),
    }


def features(found: DataFrame) -> DataFrame:
    """(path, read_failed, truncated, n_files, n_py_files, total_kb, status, deps, link_count) of archives(); an unreadable one is a row too."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    files, texts, cut = read(bytes(content))
                    deps, status = declared(texts)
                    info = next((t for p, t in sorted(texts.items()) if p.endswith(("PKG-INFO", "METADATA"))), None)
                    rows.append((path, 0, int(cut), len(files), sum(n.endswith(".py") for n, _ in files), sum(s for _, s in files) / 1024, status, [{"dep": d, "optional": o, "source": s} for d, o, s in deps], metadata(info)["link_count"] if info else 0))
                except Exception:  # anything may be in an archive; the failure is data
                    rows.append((path, 1, 0, 0, 0, 0.0, "unreadable", [], 0))
            yield pd.DataFrame(rows, columns=["path", "read_failed", "truncated", "n_files", "n_py_files", "total_kb", "status", "deps", "link_count"])

    return found.select("path", "content").mapInPandas(run, "path string, read_failed int, truncated int, n_files int, n_py_files int, total_kb double, status string, deps array<struct<dep:string,optional:int,source:string>>, link_count int")
