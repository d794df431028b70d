"""Which KB a path belongs to. ``registry`` has kb_path and kb_dir (its parent directory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.functions.paths import ancestors, depth, relative, resolved

MOST_LEVELS_DOWN = 6


def owners(paths: DataFrame, registry: DataFrame, path: str = "path") -> DataFrame:
    """The KB of the longest directory that holds each distinct path: ``path``, kb_path, kb_dir; paths outside all KBs have none.

    Nested KBs mask their parents, as the longest match wins. An equi-join on
    ancestor directories; what Spark knows of the registry's size decides how it is joined.
    """
    each = paths.select(path).where(F.col(path).isNotNull()).distinct()
    up = each.withColumn("kb_dir", F.explode(ancestors(F.col(path))))
    found = up.join(registry.select("kb_path", "kb_dir"), "kb_dir").groupBy(path).agg(F.max_by(F.struct("kb_path", "kb_dir"), F.struct(F.length("kb_dir"), "kb_path")).alias("kb"))
    return each.join(found, path, "left").select(path, "kb.kb_path", "kb.kb_dir")


def routes(item_paths: DataFrame, registry: DataFrame) -> DataFrame:
    """``item_paths(item_key, path)`` to item_key, kb_path: the one KB that holds all of an item's paths that are in any KB, else null."""
    owned = item_paths.join(owners(item_paths, registry), "path", "left")
    kbs = owned.groupBy("item_key").agg(F.count_distinct("kb_path").alias("n_kbs"), F.min("kb_path").alias("kb_path"))
    return kbs.select("item_key", F.when(F.col("n_kbs") == 1, F.col("kb_path")).alias("kb_path"))


def in_scope(cwds: DataFrame, roots: DataFrame) -> DataFrame:
    """The distinct cwds that equal or descend from a root: ``cwds(cwd)``, ``roots(root)``."""
    up = cwds.select("cwd").distinct().withColumn("root", F.explode(ancestors(F.col("cwd"))))
    return up.join(roots.select("root"), "root", "left_semi").select("cwd").distinct()


def chain_up(cwds: DataFrame, registry: DataFrame, boundaries: DataFrame) -> DataFrame:
    """KBs at and above each cwd: cwd, kb_path, kb_dir, steps (0 at the cwd).

    The walk ends, inclusively, at the nearest directory of ``boundaries(dir)``.
    """
    up = cwds.select("cwd").distinct().select("cwd", F.posexplode(ancestors(F.col("cwd"))).alias("steps", "dir"))
    end = up.join(boundaries.select("dir").distinct(), "dir").groupBy("cwd").agg(F.min("steps").alias("last"))
    reach = up.join(end, "cwd", "left").where("last IS NULL OR steps <= last")
    return reach.join(registry.select("kb_path", F.col("kb_dir").alias("dir")), "dir").select("cwd", "kb_path", F.col("dir").alias("kb_dir"), "steps")


def chain_down(cwds: DataFrame, registry: DataFrame, levels: int = MOST_LEVELS_DOWN) -> DataFrame:
    """KBs strictly below each cwd, at most ``levels`` down, not through node_modules or dot directories: cwd, kb_path, kb_dir."""
    up = registry.select("kb_path", "kb_dir").withColumn("cwd", F.explode(ancestors(F.col("kb_dir")))).where("cwd <> kb_dir")
    below = up.join(cwds.select("cwd").distinct(), "cwd")
    way = F.split(F.substring(F.col("kb_dir"), F.length("cwd") + 2, F.length("kb_dir")), "/")
    return below.where((F.size(way) <= levels) & ~F.exists(way, lambda p: (p == "node_modules") | p.startswith("."))).select("cwd", "kb_path", "kb_dir")


def chains(cwds: DataFrame, registry: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The whole chain of each cwd: descendants in order of name, then ancestors, closest first.

    Returns cwd, position (from 0), kb_path, relative_to_cwd, is_root (last of
    the chain), depth (directories above kb_dir).
    """
    up = chain_up(cwds, registry, boundaries).select("cwd", "kb_path", "kb_dir", F.lit(1).alias("part"), "steps")
    down = chain_down(cwds, registry).select("cwd", "kb_path", "kb_dir", F.lit(0).alias("part"), F.lit(0).alias("steps"))
    both = down.unionByName(up).dropDuplicates(["cwd", "kb_path"])
    order = Window.partitionBy("cwd").orderBy("part", "steps", "kb_dir")
    placed = both.withColumn("position", F.row_number().over(order) - 1)
    last = F.max("position").over(Window.partitionBy("cwd"))
    return placed.select("cwd", "position", "kb_path", relative(F.col("cwd"), F.col("kb_dir")).alias("relative_to_cwd"), (F.col("position") == last).alias("is_root"), depth(F.col("kb_dir")).alias("depth"))


def region_globs(registry: DataFrame) -> DataFrame:
    """kb_path, globs: everything below a KB's directory, less its nested KBs' directories."""
    up = registry.select(F.col("kb_dir").alias("child")).withColumn("kb_dir", F.explode(ancestors(F.col("child")))).where("kb_dir <> child")
    nested = registry.join(up, "kb_dir").groupBy("kb_path").agg(F.array_sort(F.collect_set(F.concat(F.lit("!"), F.expr("substring(child, length(kb_dir) + 2)"), F.lit("/**")))).alias("nested"))
    return registry.join(nested, "kb_path", "left").select("kb_path", F.concat(F.array(F.lit("**")), F.coalesce("nested", F.array().cast("array<string>"))).alias("globs"))


def path_owners(items: DataFrame, registry: DataFrame) -> DataFrame:
    """``items(item_key, kb_dir, paths)`` to item_key, owned: the paths in order, as struct(place, given, path, owner).

    Relative paths are seen from kb_dir, and blank ones are left out; an item without others has no row.
    """
    each = items.select("item_key", "kb_dir", F.posexplode("paths").alias("place", "given")).where(F.regexp_replace("given", r"\s+", "") != "")
    each = each.select("item_key", "place", "given", resolved(F.col("kb_dir"), F.col("given")).alias("path"))
    own = owners(each, registry).select("path", F.col("kb_path").alias("owner"))
    return each.join(own, "path", "left").groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("place", "given", "path", "owner"))).alias("owned"))


def kept_of(owned: str, kb_path: Column, kb_dir: Column) -> list[Column]:
    """paths_kept and paths_dropped of an item of ``kb_path`` with ``owned`` paths (``path_owners``), null for none."""
    none = F.array().cast("array<struct<place:int,given:string,path:string,owner:string>>")
    paths = F.coalesce(F.col(owned), none)
    own = lambda o: F.coalesce(o["owner"] == kb_path, F.lit(False))
    kept = F.array_distinct(F.transform(F.filter(paths, own), lambda o: relative(kb_dir, o["path"])))
    dropped = F.transform(F.filter(paths, lambda o: ~own(o)), lambda o: o["given"])
    return [kept.alias("paths_kept"), dropped.alias("paths_dropped")]


def kept_paths(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Paths of items as their KB keeps them.

    ``items(item_key, kb_path, kb_dir, paths)`` to item_key, paths_kept (relative to
    kb_dir, distinct, in order), paths_dropped (as given, outside the KB's region).
    Relative paths are seen from kb_dir; blank ones are neither kept nor dropped.
    """
    both = items.select("item_key", "kb_path", "kb_dir").join(path_owners(items, registry), "item_key", "left")
    return both.select("item_key", *kept_of("owned", F.col("kb_path"), F.col("kb_dir")))
