"""File trees: directories through Spark's binary reader, git checkouts on the driver."""

from __future__ import annotations

import fnmatch
import re
import subprocess
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pattern(globs: Sequence[str]) -> str:
    return "|".join("(?:" + re.sub(r"\(\?s:(.*)\)\\[zZ]", r"\1", fnmatch.translate(g.removeprefix("**/"))) + ")" for g in globs)


def directory(spark: SparkSession, root: str, patterns: Sequence[str] = ("**/*.md",), exclude: Sequence[str] = ()) -> DataFrame:
    """(path, text, updated_at) of the matching files; files that are not UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^\w+:/+", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace(F.col("path"), r"^\w+:/+", "/"), "^" + re.escape(base) + "/", "")
    rows = files.select(path.alias("path"), F.col("content"), F.col("modificationTime").alias("updated_at"))
    rows = rows.where(F.col("path").rlike("^(?:" + _pattern(patterns) + ")$"))
    if exclude:
        rows = rows.where(~F.col("path").rlike("^(?:" + _pattern(exclude) + ")$"))
    return rows.where(F.is_valid_utf8("content")).select("path", F.decode("content", F.lit("UTF-8")).alias("text"), "updated_at")


def _git(*args: str, cwd: str | None = None) -> str:
    return subprocess.run(["git", *args], cwd=cwd, check=True, capture_output=True, text=True).stdout.strip()


def git_checkout(url: str, cache: str, ref: str = "HEAD") -> str:
    """A clone of ``url`` in ``cache``, brought to ``ref``; refuses a cache of another origin."""
    if (Path(cache) / ".git").exists():
        if (origin := _git("remote", "get-url", "origin", cwd=cache)) != url:
            raise ValueError(f"{cache} is a clone of {origin}")
        _git("fetch", "--depth", "1", "origin", ref, cwd=cache)
        _git("reset", "--hard", "FETCH_HEAD", cwd=cache)
    else:
        _git("clone", "--depth", "1", *(["--branch", ref] if ref != "HEAD" else []), url, cache)
    return cache


def git_files(spark: SparkSession, url: str, cache: str, ref: str = "HEAD", subdir: str = "", patterns: Sequence[str] = ("**/*.md",), exclude: Sequence[str] = ()) -> DataFrame:
    """As ``directory``, with the time of each file's last commit, or of the tip where that is unknown."""
    root = git_checkout(url, cache, ref)
    tip = int(_git("log", "-1", "--format=%ct", cwd=root))
    times: list[tuple[str, int]] = []
    now = tip
    seen: set[str] = set()
    for line in _git("log", "--format=@%ct", "--name-only", cwd=root).splitlines():
        if line.startswith("@"):
            now = int(line[1:])
        elif line and line not in seen:
            seen.add(line)
            times.append((line.removeprefix(subdir.strip("/") + "/") if subdir else line, now))
    known = spark.createDataFrame(times or [("", tip)], "path string, ct long")
    files = directory(spark, "file://" + str(Path(root, subdir).resolve()), patterns, exclude).where("path NOT LIKE '.git/%'")
    return files.join(known, "path", "left").select("path", "text", F.timestamp_seconds(F.coalesce("ct", F.lit(tip))).alias("updated_at"))
