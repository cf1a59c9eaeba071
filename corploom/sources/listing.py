"""File trees as rows: listings, the choice of code and documentation files, digests of whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is taken as code of each category, what as documentation, and what is passed by.
SUFFIXES = {"rust": (".rs",), "shell": (".sh", ".bash", ".zsh", ".fish", ".bats")}
NAMES = {"rust": (), "shell": ("Makefile", "makefile", "GNUmakefile", "Dockerfile")}
DOCS, RELEASE_NOTES = (".md", ".markdown", ".rst"), ("changelog", "changes", "history", "news", "release")
SKIPPED = (".git", "target", "node_modules", "vendor", "third_party", "build", "dist")
SHEBANG = r"^#!\s*(/usr/bin/env\s+(-S\s+)?|/\S*/)?(sh|bash|zsh|dash|ksh|fish)(?![A-Za-z0-9_])"


def listing(spark: SparkSession, root: str, heads: bool = False) -> DataFrame:
    """(path, size, head) of the files below ``root``, by their path from there; contents are read only for ``heads``, of 256 bytes. Spark's scan passes by files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    head = F.decode(F.substring("content", 1, 256), "ISO-8859-1") if heads else F.lit(None).cast("string")
    return files.select(below.alias("path"), F.col("length").alias("size"), head.alias("head"))


def is_kind(category: str, kind: str = "code") -> Column:
    """Whether a row of (path, head) is code of a category or, of ``kind`` docs, documentation, by its name and, a shell script without a suffix, its head; size and folder don't matter."""
    if kind not in ("code", "docs") or kind == "code" and category not in SUFFIXES:
        raise ValueError(f"no rule for {kind} of {category}")
    name = F.substring_index("path", "/", -1)
    ends = lambda c, suffixes: F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(c, s))
    if kind == "docs":
        return ends(F.lower(name), DOCS) & ~F.exists(F.array(*map(F.lit, RELEASE_NOTES)), lambda p: F.startswith(F.lower(name), p))
    wanted = ends(name, SUFFIXES[category]) | name.isin(*NAMES[category])
    if category == "shell":
        wanted |= name.rlike(r"^[.]*[^.]+$") & F.coalesce(F.col("head").rlike(SHEBANG), F.lit(False))
    return wanted


def select_files(files: DataFrame, category: str, max_bytes: int = 1 << 20, kind: str = "code") -> DataFrame:
    """Rows of (path, size, head) that are code of a category or, of ``kind`` docs, documentation; a shell script without a suffix is told by its head.

    Empty and too large files, paths with a space or no path, and what is below a skipped folder are left out.
    """
    skipped = "(^|/)(" + "|".join(s.replace(".", "[.]") for s in SKIPPED) + ")/"
    return files.where(is_kind(category, kind) & F.col("size").between(1, max_bytes) & ~F.contains("path", F.lit(" ")) & ~F.col("path").rlike(skipped))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, digest): SHA-256 of each whole file below ``root``; a file must fit in a task. Spark's scan passes by files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))
