"""Imports resolved to files in four stages; what one stage leaves open falls through to the next.

* A relative import names a file in a folder some levels above the importer's:
  ``name.py`` or ``name__init__.py`` there (0.95).
* A module is a file of the importer's folder, as it stands or with ``.py`` (0.9).
* A module is a part of some path; the first path counts (0.85).
* A name is a part of a file's stem, or the stem a part of the name, in lower
  case; the least difference of lengths counts, then the first path (0.3).

"Is a part of" is an equality join: all substrings of paths (or stems, or
names) that have the length of something asked for are a table, reduced to the
asked ones and to the best file of each before it meets an import.  So no pair
is tried that does not match, and no popular substring multiplies rows.

Empty modules stand for the name; empty names and stems match nothing; rows
without a file or a name take no part; repeated imports give one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.lineage import cut

KEY = ["file", "module", "name", "relative", "up"]


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _stem(path: Column) -> Column:
    """A file's name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")


def _at(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _first_file(asked: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """The first candidate path of each import that is a file."""
    tried = asked.select(*KEY, F.posexplode(candidates).alias("n", "path")).join(files, "path")
    return tried.groupBy(*KEY).agg(F.min_by("path", "n").alias("target"))


def substrings(texts: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``texts`` with each of its distinct substrings (``part``) among ``wanted`` (``part``)."""
    sizes = [r["n"] for r in wanted.select(F.length("part").alias("n")).distinct().collect()]  # as many as names have lengths
    if not sizes:
        return texts.withColumn("part", F.lit("")).limit(0)
    size = texts.withColumn("_n", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("_n") <= F.length(column))
    starts = F.sequence(F.lit(1), F.length(column) - F.col("_n") + 1)
    parts = size.withColumn("part", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(column), i, F.col("_n"))))))
    return parts.drop("_n").join(wanted.select("part").distinct(), "part", "left_semi")


def _open(asked: DataFrame, found: DataFrame) -> DataFrame:
    return cut(asked.join(found.select(*[F.col(k).alias(f"_{k}") for k in KEY]), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY], "left_anti"), "open")


def resolved(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, module, name, relative, up, target, confidence) of the imports (without the last two) that some file (path) answers."""
    paths = cut(files.select("path").where("path is not null").distinct(), "paths")
    asked = cut(imports.select("file", F.coalesce("module", F.lit("")).alias("module"), "name", F.coalesce("relative", F.lit(False)).alias("relative"), F.coalesce("up", F.lit(0)).alias("up")).where("file is not null and name is not null").distinct(), "imports")
    module = F.when(F.col("module") == "", F.col("name")).otherwise(F.col("module"))

    above = F.aggregate(F.sequence(F.lit(0), F.col("up")), F.col("file"), lambda p, _: _folder(p))
    inner = F.when(F.col("module") == "", above).otherwise(_at(above, F.replace("module", F.lit("."), F.lit("/"))))
    near = cut(_first_file(asked.where("relative"), paths, F.array(*[_at(inner, F.concat("name", F.lit(e))) for e in (".py", "__init__.py")])), "relative")
    rest = _open(asked, near)

    own = _at(_folder(F.col("file")), module)
    local = cut(_first_file(rest, paths, F.array(own, F.concat(own, F.lit(".py")))), "local")
    rest = _open(rest, local)

    wanted = rest.select(module.alias("part")).where("part <> ''").distinct()
    first = substrings(paths, "path", wanted).groupBy("part").agg(F.min("path").alias("target"))
    inside = cut(rest.withColumn("part", module).join(first, "part").select(*KEY, "target"), "inside")
    rest = _open(rest, inside)

    stems = cut(paths.select(F.lower(_stem(F.col("path"))).alias("stem"), "path").where("stem <> ''").groupBy("stem").agg(F.min("path").alias("path")), "stems")
    names = cut(rest.select(F.lower("name").alias("low")).where("low <> ''").distinct(), "names")
    longer = substrings(stems, "stem", names.select(F.col("low").alias("part"))).groupBy(F.col("part").alias("low")).agg(F.min(F.struct(F.length("stem").alias("n"), "path")).alias("x"))
    longer = longer.select("low", F.struct((F.col("x.n") - F.length("low")).alias("n"), F.col("x.path").alias("path")).alias("x"))
    shorter = substrings(names, "low", stems.select(F.col("stem").alias("part"))).join(stems.withColumnRenamed("stem", "part"), "part")
    shorter = shorter.groupBy("low").agg(F.min(F.struct((F.length("low") - F.length("part")).alias("n"), "path")).alias("x"))
    best = longer.unionByName(shorter).groupBy("low").agg(F.min("x").alias("x"))
    fuzzy = rest.withColumn("low", F.lower("name")).join(best, "low").select(*KEY, F.col("x.path").alias("target"))

    out = None
    for part, confidence in ((near, 0.95), (local, 0.9), (inside, 0.85), (fuzzy, 0.3)):
        rows = part.withColumn("confidence", F.lit(confidence))
        out = rows if out is None else out.unionByName(rows)
    return out
