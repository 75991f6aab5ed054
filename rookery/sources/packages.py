"""Resolved packages, manifests and changed files, as tables."""

from __future__ import annotations

import subprocess
import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = """
packages array<struct<id:string,name:string,version:string,manifest_path:string,description:string,license:string>>,
workspace_members array<string>, workspace_root string,
resolve struct<nodes:array<struct<id:string,deps:array<struct<name:string,pkg:string,dep_kinds:array<struct<kind:string>>>>>>,root:string>
"""


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A metadata document of resolved packages, one row."""
    return spark.read.schema(METADATA).json(path, multiLine=True)


def crates(metadata: DataFrame) -> DataFrame:
    """(id, name, version, is_member): one row a package; id is ``name@version``."""
    p = metadata.select("workspace_members", F.explode("packages").alias("p"))
    return p.select(F.concat_ws("@", "p.name", "p.version").alias("id"), "p.name", "p.version", F.array_contains("workspace_members", F.col("p.id")).alias("is_member"))


def links(metadata: DataFrame) -> DataFrame:
    """(src, dst, kind): one row for each kind of each resolved dependency; without kinds it is normal.

    Only repeats that follow one another are one: a list normal, dev, normal gives three rows.
    """
    names = metadata.select(F.explode("packages").alias("p")).select("p.id", F.concat_ws("@", "p.name", "p.version").alias("name"))
    dep = metadata.select(F.explode("resolve.nodes").alias("n")).select(F.col("n.id").alias("id"), F.explode("n.deps").alias("d"))
    kinds = F.transform(F.coalesce("d.dep_kinds", F.array()), lambda k: F.coalesce(k["kind"], F.lit("normal")))
    kinds = F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("normal")))
    once = F.filter(kinds, lambda k, i: (i == 0) | (F.get(kinds, i - 1) != k))
    each = dep.select("id", F.col("d.pkg").alias("pkg"), F.explode(once).alias("kind"))
    return each.join(names.select("id", F.col("name").alias("src")), "id").join(names.select(F.col("id").alias("pkg"), F.col("name").alias("dst")), "pkg").select("src", "dst", "kind")


TABLES = {"dependencies": "normal", "dev-dependencies": "dev", "build-dependencies": "build"}


def requirement(value) -> str:
    """What a manifest asks for: a version, a path, a repository, the workspace's, or anything."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        for key in ("version", "path", "git"):
            if isinstance(value.get(key), str):
                return value[key]
        if value.get("workspace") is True:
            return "workspace"
    return "*"


def parse_manifest(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, name, requirement) of a manifest, tables of targets too, of which later ones win; nothing if it can't be parsed."""
    try:
        doc = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return []
    found: dict[tuple[str, str], str] = {}
    for part in (doc, *(t for t in (doc.get("target") or {}).values() if isinstance(t, dict))):
        for table, kind in TABLES.items():
            for name, value in (part.get(table) or {}).items():
                found[kind, name] = requirement(value)
    return [(k, n, r) for (k, n), r in sorted(found.items())]


def manifests(files: DataFrame) -> DataFrame:
    """(path, kind, name, req) of manifest files (path, text), parsed where they are."""

    def run(batches):
        for pdf in batches:
            rows = [(path, *r) for path, text in zip(pdf["path"], pdf["text"], strict=True) for r in parse_manifest(text)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "req"])

    return files.select("path", "text").mapInPandas(run, "path string, kind string, name string, req string")


def changed_files(spark: SparkSession, repository: str, base: str | None = None) -> DataFrame:
    """(path) changed since the base revision, tracked and untracked; empty where there is no repository.

    The list comes from the version control of the driver's machine.
    """
    git = lambda *a: subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True, timeout=60)
    schema = "path string"
    if not (Path(repository) / ".git").exists():
        return spark.createDataFrame([], schema)
    names = [base] if base else ["main", "master", "origin/main", "origin/master"]
    at = next((n for n in names if git("rev-parse", "--verify", "-q", n).returncode == 0), "HEAD")
    merge = git("merge-base", "HEAD", at).stdout.strip() or at
    lines = git("diff", "--name-only", merge).stdout.splitlines() + git("ls-files", "--others", "--exclude-standard").stdout.splitlines()
    return spark.createDataFrame([(x,) for x in sorted(set(lines))], schema)


def rebased(paths: DataFrame, root: str) -> DataFrame:
    """Paths below ``root``, relative to it; others go."""
    at = root.rstrip("/") + "/" if root not in ("", ".") else ""
    return paths.where(F.col("path").startswith(at)).select(F.substring("path", F.lit(len(at) + 1), F.length("path")).alias("path"))
