"""Source trees, snapshots of them, and what is read again."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakegraph.functions import names

# Directories that hold no sources of the project.
EXCLUDED_DIRS = ("build", "target", "out", "node_modules", ".git", ".gradle")


def source_files(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """(path, repo_id, content, content_hash, n_bytes) of the files below root, whose first folder is the repository.

    Files in excluded directories are left out. The content is UTF-8 text; the hash is SHA-1 over the bytes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + root.replace("file://", "").rstrip("/").replace(".", r"\.") + "/", "")
    named = raw.select(rel.alias("rel"), "content", F.col("length").alias("n_bytes"))
    inside = ~F.col("rel").rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in EXCLUDED_DIRS) + ")/")
    return named.where(inside).select(
        F.regexp_replace("rel", r"^[^/]*/", "").alias("path"), F.substring_index("rel", "/", 1).alias("repo_id"),
        F.decode("content", "UTF-8").alias("content"), F.sha1("content").alias("content_hash"), "n_bytes",
    )


def unseen(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Files that the previous snapshot (path, content_hash) doesn't have with this content."""
    return files.join(previous.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")


def blobs(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changes with the content of their new path; null where the tree doesn't have it."""
    return changes.join(files.select(F.col("path").alias("new_path"), "content"), "new_path", "left")


def routed(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Java changes, and all others with their language."""
    marked = changes.withColumn("language", names.language(F.col("new_path")))
    return marked.where("language = 'java'"), marked.where("language <> 'java' or language is null")


def git_patch(repository: str, base: str, head: str) -> str:
    """The patch between two trees, renames detected, as text for wakegraph.sources.patches."""
    for ref in (base, head):
        if ref.startswith("-"):
            raise ValueError(f"not a revision: {ref}")
    done = subprocess.run(["git", "-C", repository, "diff", "--find-renames", "--no-color", base, head, "--"], capture_output=True, text=True, check=True)
    return done.stdout


def properties(text: str) -> dict[str, str]:
    """`key=value` lines of a properties file; comments and lines without `=` are skipped, later keys win."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!" and "=" in line:
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip()
    return out


def properties_of(texts: DataFrame) -> DataFrame:
    """(file, key, value) of properties files texts(file, content), as of properties()."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = texts.where("content is not null").select("file", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("n", "line")).select("file", "n", bare("line").alias("line"))
    kept = lines.where(F.col("line").contains("=") & ~F.col("line").rlike("^[#!]"))
    split = kept.select("file", "n", bare(F.substring_index("line", "=", 1)).alias("key"), bare(F.regexp_replace("line", "(?s)^[^=]*=", "")).alias("value"))
    return split.groupBy("file", "key").agg(F.max_by("value", "n").alias("value"))


def resolved_path(value: str, root: str) -> str:
    """A configured path: as it is with a drive letter or leading slash, else below the repository's root."""
    value = value.replace("\\", "/")
    absolute = value.startswith("/") or (len(value) > 1 and value[1] == ":")
    return value if absolute else f"{root.rstrip('/')}/{value}"
