"""Resolve relative import specifiers by joining candidate paths with the files that exist, links followed, instead of asking a disk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.plans.storage import passing, settled

#: Links that are followed one after the other before a path counts as a circle.
FOLLOWED = 40

#: Extensions tried, in order; sources that a script's extension may stand for.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".json")
ALIASES = {".js": (".ts", ".tsx", ".js"), ".jsx": (".tsx", ".jsx")}


#: A path with a part that is empty, . or ..
ODD = r"(^|/)\.{0,2}(/|$)"


def joined_path(folder: Column, specifier: Column) -> Column:
    """folder/specifier with . and .. worked out; null where it leaves the tree. Most need no list of parts: . or some .. and then names, below names."""
    rest = F.regexp_replace(specifier, r"^(\./|(\.\./)+)", "")
    up = F.floor((F.length(specifier) - F.length(rest)) / 3)
    left = F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + 1 - up
    plain = F.when(left > 0, F.concat(F.call_function("substring_index", folder, F.lit("/"), left.cast("int")), F.lit("/"), rest)).when(left == 0, rest)
    return F.when(~folder.rlike(ODD) & ~rest.rlike(ODD), plain).otherwise(_worked_out(folder, specifier))


def _worked_out(folder: Column, specifier: Column) -> Column:
    parts = F.filter(F.split(F.when(specifier.startswith("/"), specifier).otherwise(F.concat(folder, F.lit("/"), specifier)), "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.when((F.size(a) == 0) | (F.element_at(F.concat(F.array(F.lit("..")), a), -1) == ".."), F.concat(a, F.array(p))).otherwise(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))).otherwise(F.concat(a, F.array(p))))
    return F.when(~F.exists(up, lambda p: p == ".."), F.array_join(up, "/"))


def candidates(path: Column) -> Column:
    """Paths that an import of path may mean, the first that exists counts."""
    aliases = [F.when(path.endswith(e), F.concat(F.regexp_replace(path, rf"\{e}$", ""), F.lit(x))) for e, xs in ALIASES.items() for x in xs]
    own = [path, *(F.concat(path, F.lit(e)) for e in EXTENSIONS), *(F.concat(path, F.lit(f"/index{e}")) for e in EXTENSIONS)]
    return F.array_compact(F.array(*aliases, *own))


def _prefixed(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, link, target) of paths (path) that lie at or below links (link, target): the longest link counts."""
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("link"))
    return above.join(links, "link").groupBy("path").agg(F.max_by(F.struct("link", "target"), F.length("link")).alias("m")).select("path", "m.*")


def _moved(path: Column, link: Column, target: Column) -> Column:
    """path with link at its beginning replaced by target; target may be empty, the root."""
    rest = F.substring(path, F.length(link) + 2, F.length(path))
    return F.array_join(F.filter(F.array(target, rest), lambda p: p != ""), "/")


def real_paths(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, real) of distinct paths (path): links (link, target; null where a target leaves the tree) are followed until none is left.

    A round follows one link of each path that has one: the longest prefix that is one. Paths that leave the tree, and
    those that lead in a circle, have null.
    """
    with passing(paths.sparkSession) as kept:
        way = settled(links.select("link", "target"))
        now, done, rounds = settled(paths.select("path", F.col("path").alias("real"))), [], 0
        while not now.isEmpty():
            asked = now.select(F.col("real").alias("path")).distinct()
            told = settled(_prefixed(asked, way))
            step = settled(now.join(told.withColumnRenamed("path", "real"), "real", "left"))
            done.append(step.filter("link is null").select("path", "real"))
            on = step.filter("link is not null").select("path", F.when(F.col("target").isNotNull(), _moved(F.col("real"), F.col("link"), F.col("target"))).alias("real"))
            rounds += 1
            left = on.select("path", F.lit(None).cast("string").alias("real")) if rounds == FOLLOWED else on.filter("real is null")
            done.append(left)
            now = settled(on.filter("real is not null")) if rounds < FOLLOWED else now.limit(0)
        found = settled(reduce(DataFrame.unionByName, done)) if done else now
        kept.append(found)
    return found


def resolved(imports: DataFrame, files: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """imports (path, ord, specifier) with resolved; bare specifiers and those without a file have null.

    files (path) are all that exist, scanned or not, by their real paths. links (link, target) are followed in what is
    imported; an importer's own folder is taken as it is named. The first candidate that exists counts. Candidates are
    tried once for each path that is meant, however many imports mean it.
    """
    relative = F.col("specifier").startswith(".") | F.col("specifier").startswith("/")
    folder = F.regexp_replace("path", "/?[^/]+$", "")
    based = settled(imports.select("path", "ord", "specifier", F.when(relative, joined_path(folder, F.col("specifier"))).alias("base")))
    tried = based.filter("base is not null").select("base").distinct().select("base", F.posexplode(candidates(F.col("base"))).alias("rank", "target"))
    there = files.select(F.col("path").alias("target")).distinct()
    if links is not None:
        real = real_paths(tried.select(F.col("target").alias("path")).distinct(), links).toDF("target", "real").filter("real is not null")
        hits = tried.join(real, "target").drop("target").withColumnRenamed("real", "target").join(there, "target", "left_semi")
    else:
        hits = tried.join(there, "target", "left_semi")
    best = hits.groupBy("base").agg(F.min(F.struct("rank", "target")).alias("m")).select("base", F.col("m.target").alias("resolved"))
    return based.join(best, "base", "left").select("path", "ord", "specifier", "resolved")
