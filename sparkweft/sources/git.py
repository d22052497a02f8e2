"""Change sets: git's own output as tables of line ranges."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweft import model

#: Fixed value: how git heads a hunk.
HUNK = r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
RANGE = "path string, start int, end int"


def statuses(lines: DataFrame) -> DataFrame:
    """path, old_path, status of name-status lines (line)."""
    parts = F.split("line", "\t")
    code, moved = F.substring("line", 1, 1), (F.substring("line", 1, 1).isin("R", "C")) & (F.size(parts) >= 3)
    words = F.create_map(*(F.lit(x) for pair in model.STATUS_WORDS.items() for x in pair))
    kept = lines.where((F.trim("line") != "") & (F.size(parts) >= 2))
    return kept.select(
        F.when(moved, F.try_element_at(parts, F.lit(3))).otherwise(F.try_element_at(parts, F.lit(2))).alias("path"),
        F.when(moved, F.try_element_at(parts, F.lit(2))).otherwise("").alias("old_path"),
        F.coalesce(F.try_element_at(words, code), F.try_element_at(parts, F.lit(1))).alias("status"),
    )


def ranges(patch: DataFrame) -> DataFrame:
    """path, start, end from the lines (diff, seq, line) of zero-context patches; ``diff`` names one patch.

    A hunk belongs to the last file named above it. A deletion leaves the single line it stood at.
    """
    of = lambda k: F.regexp_extract("line", HUNK, k)
    size = lambda k: F.when(of(k) == "", F.lit(1)).otherwise(of(k).try_cast("int"))
    hunk, mark = F.col("line").rlike(HUNK), F.col("line").startswith("diff --git ")
    over = Window.partitionBy("diff").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # content is told from file headers by its place: a hunk's counts say how many of the lines after it are its own
    placed = patch.withColumn("n", F.count_if(~F.col("line").startswith("\\")).over(over))
    last = F.last(F.when(hunk, F.struct("n", (size(1) + size(3)).alias("lines"))).when(mark, F.struct("n", F.lit(0).alias("lines"))), ignorenulls=True).over(over)
    placed = placed.withColumn("last", last)
    content = ~hunk & ~mark & F.coalesce(F.col("n") <= F.col("last.n") + F.col("last.lines"), F.lit(False))
    plus = F.regexp_replace(F.regexp_replace(F.trim(F.substring("line", 5, 1 << 20)), '^"(.*)"$', "$1"), "^[ab]/", "")
    named = (
        F.when(content, None)
        .when(F.col("line").startswith("+++ /dev/null"), F.lit(""))
        .when(F.col("line").startswith("+++ "), plus)
        .when(mark, F.regexp_extract("line", r"^diff --git .* b/(.*)$", 1))
    )
    at = placed.withColumn("path", F.last(named, ignorenulls=True).over(over)).where(hunk & (F.col("path") != ""))
    start, count = of(2).cast("int"), size(3)
    first = F.when(count == 0, F.greatest(F.lit(1), start)).otherwise(start)
    return at.select("path", first.alias("start"), F.when(count == 0, first).otherwise(start + count - 1).alias("end"))


def _git(root: str, *args: str, check: bool = True) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=60)
    if check and done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip() or "git failed")
    return done.stdout.decode("utf-8", "replace")


def head(root: str) -> str:
    """The short revision that a repository stands at; empty where there is none."""
    try:
        return _git(root, "rev-parse", "--short", "HEAD", check=False).strip()
    except (OSError, subprocess.SubprocessError):
        return ""


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, i, line) for i, line in enumerate(text.split("\n"))], "diff int, seq int, line string")


def diff(spark: SparkSession, root: str, revision: str = "HEAD", staged: bool = False) -> DataFrame:
    """path, status, old_path, start, end of a repository's changes against a revision, a range, or 'worktree'.

    Files that git does not track yet belong to the working tree, so they count where that is compared.
    """
    top = _git(root, "rev-parse", "--show-toplevel").strip()
    args = ["-c", "core.quotepath=off", "diff", *(["--cached"] if staged else []), *([] if revision == "worktree" else [revision]), "-M", "--no-color", "--no-ext-diff"]
    found = statuses(_lines(spark, _git(top, *args, "--name-status")).select("line"))
    lines = ranges(_lines(spark, _git(top, *args, "-U0")))
    out = found.join(lines, "path", "left")
    if not staged and ".." not in revision:
        new = []
        for name in _git(top, "ls-files", "--others", "--exclude-standard", check=False).splitlines():
            if os.path.isfile(os.path.join(top, name)):
                with open(os.path.join(top, name), encoding="utf-8", errors="replace") as f:
                    new.append((name, "added", "", 1, max(1, len(f.read().splitlines()))))
        if new:
            out = out.unionByName(spark.createDataFrame(new, "path string, status string, old_path string, start int, end int"))
    return out.select("path", "status", "old_path", "start", "end")


def for_index(changes: DataFrame) -> DataFrame:
    """Ranges that an index can answer for: of files still there, with lines."""
    return changes.where("status != 'deleted' and start is not null")
