"""From a spelling to symbols, for a column of spellings at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions import expr
from sparkweft.session import durable


#: So many spellings at most are broadcast to the names that they may occur in.
FEW = 2000


def files(spellings: DataFrame, known: DataFrame, root: str = "") -> DataFrame:
    """wanted, path: each spelling's file: as it stands, under the root, else the shortest path that ends with it."""
    wanted = spellings.select("wanted").distinct()
    trimmed = F.regexp_replace("wanted", r"^\./", "")
    exact = wanted.withColumn("__p", F.explode(F.array("wanted", F.concat_ws("/", F.lit(root.rstrip("/")), trimmed)))).join(known.select("path"), F.col("__p") == F.col("path"))
    # the last component is equal whenever the suffix is, and makes the join an equi-join
    last = lambda c: expr.ascii_lower(F.substring_index(F.col(c), "/", -1))
    tails = wanted.withColumn("__last", last("wanted")).join(known.select("path", last("path").alias("__last")), "__last")
    suffix = tails.where(expr.like(F.col("path"), F.concat(F.lit("%/"), trimmed)))
    both = exact.select("wanted", "path", F.when(F.col("path") == F.col("wanted"), 0).otherwise(1).alias("stage")).unionByName(suffix.select("wanted", "path", F.lit(2).alias("stage")))
    order = Window.partitionBy("wanted").orderBy("stage", F.length("path"), "path")
    return both.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("wanted", "path")


def _literal(pattern: Column) -> Column:
    """The longest run of a LIKE pattern without wildcards, lower-cased: whatever the pattern matches holds it."""
    runs = F.split(expr.ascii_lower(pattern), "[%_]")
    return F.aggregate(runs, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def _tails(text: Column) -> Column:
    """What stands after each :: of a name, lower-cased: a spelling ends the name at a :: if it equals one of them."""
    low = expr.ascii_lower(text)
    at = F.filter(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)) == "::")
    return F.when(F.length(low) >= 2, F.array_distinct(F.transform(at, lambda i: F.substring(low, i + 2, F.length(low)))))


def containing(patterns: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """patterns (__name, ...) with the names whose column holds __name's literal run: an equi-join on its first three characters.

    A run of less than three characters, down to none, is its own key, so the join is never a product of the two sides.
    """
    text = expr.ascii_lower(F.coalesce(F.col(column), F.lit("")))
    size = F.length(text)
    grams = lambda k: F.when(size >= k, F.transform(F.sequence(F.lit(1), size - (k - 1)), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>"))
    asked = patterns.withColumn("__key", F.substring(_literal(F.col("__name")), 1, 3))
    # only lengths that are asked for are listed
    lengths = sorted(r[0] for r in asked.select(F.length("__key").alias("k")).distinct().collect())
    if not lengths:
        return asked.drop("__key").join(names, F.lit(False))
    every = F.array_distinct(F.concat(*(grams(k) if k else F.array(F.lit("")) for k in lengths)))
    if asked.limit(FEW + 1).count() <= FEW:
        asked = F.broadcast(asked)
    return asked.join(names.withColumn("__key", F.explode(every)), "__key").drop("__key")


def cascade(references: DataFrame, symbols: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """reference, stage, rank, usr: the candidates of the first stage that has any.

    1 the usr itself; 2 path:line of a declaration or definition (places: usr, path, line); 3 equal qualified or plain
    name, with the signature where one is given; 4 a qualified name that ends with ::name; 5 a name that contains it. Stages 3 to 5
    rank project symbols first, then full records, shorter names, names.
    """
    name, signature = expr.split_signature(F.col("reference"))
    asked = durable(references.select("reference").distinct()).withColumns({"__name": name, "__signature": signature})
    row = symbols.select(F.col("usr"), "name", "qualified", "signature", "in_project", "stub")
    fits = F.col("__signature").isNull() | expr.contains(F.col("signature"), F.col("__signature"))
    parts = [asked.join(row, F.col("reference") == F.col("usr").cast("string")).select("reference", "usr", F.lit(1).alias("stage"))]
    if places is not None:
        path, line = expr.split_location(F.col("reference"))
        at = asked.select("reference", path.alias("wanted"), line.alias("__line")).where("wanted is not null")
        located = at.join(files(at, places.select("path").distinct()), "wanted").join(places, ["path"]).where("__line = line")
        parts.append(located.select("reference", "usr", F.lit(2).alias("stage")).distinct())
    for column in ("qualified", "name"):
        parts.append(asked.join(row, F.col("__name") == F.col(column)).where(fits).select("reference", "usr", F.lit(3).alias("stage")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # each scan below is only for spellings that nothing above it settled
    found = durable(found.distinct())
    left = durable(asked.join(found.select("reference").distinct(), "reference", "left_anti"))
    open_pattern = F.col("__name").rlike("[%_]")
    ends_with = expr.like(F.col("qualified"), F.concat(F.lit("%::"), F.col("__name")))
    tails = row.withColumn("__tail", F.explode(_tails(F.col("qualified"))))
    plain = left.where(~open_pattern).withColumn("__tail", expr.ascii_lower(F.col("__name"))).join(tails, "__tail").where(fits)
    wild = containing(left.where(open_pattern), row, "qualified").where(ends_with & fits)
    fourth = durable(plain.select("reference", "usr").unionByName(wild.select("reference", "usr")).distinct().withColumn("stage", F.lit(4)))
    left = left.join(fourth.select("reference").distinct(), "reference", "left_anti")
    fifth = containing(left, row, "name").where(expr.contains(F.col("name"), F.col("__name")) & fits).select("reference", "usr", F.lit(5).alias("stage")).distinct()
    found = found.unionByName(fourth).unionByName(fifth)
    first = Window.partitionBy("reference")
    found = found.withColumn("__first", F.min("stage").over(first)).where("stage = __first").drop("__first")
    label = expr.first_filled("qualified", "name")
    order = Window.partitionBy("reference").orderBy((~F.coalesce("in_project", F.lit(False))).cast("int"), F.coalesce("stub", F.lit(0)).cast("int"), F.length(F.coalesce(label, F.lit(""))), F.coalesce("qualified", F.lit("")), "usr")
    ranked = found.join(row, "usr").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.select("reference", F.col("stage").cast("long").alias("stage"), "rank", "usr")


def narrowed(candidates: DataFrame, places: DataFrame, path: str) -> DataFrame:
    """Candidates in a file (its suffix will do), for references that then have any left; all otherwise."""
    inside = places.where(expr.same_file(F.col("path"), F.lit(path))).select("usr").distinct().withColumn("__in", F.lit(True))
    marked = candidates.join(inside, "usr", "left").withColumn("__any", F.max(F.coalesce("__in", F.lit(False))).over(Window.partitionBy("reference")))
    return marked.where(F.coalesce("__in", F.lit(False)) | ~F.col("__any")).drop("__in", "__any")


def search(symbols: DataFrame, text: str, kind: str | None = None, project_only: bool = True) -> DataFrame:
    """Symbols whose name or qualified name contains the text; the order of the answer is length, then name."""
    hit = expr.contains(F.col("name"), F.lit(text)) | expr.contains(F.col("qualified"), F.lit(text))
    found = symbols.where(hit)
    if kind:
        found = found.where(F.col("kind") == kind)
    if project_only:
        found = found.where("in_project")
    return found


def search_order() -> list:
    return [F.length(F.coalesce("qualified", "name")), F.col("qualified").asc_nulls_first(), F.col("usr")]
