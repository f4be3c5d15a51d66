"""Files connected through a dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.skew import skew_join
from folioflow.session import kept

# Import statements of Python sources.
IMPORT = r"(?m)^[ \t]*(?:import|from)[ \t]+([A-Za-z_][\w.]*)"
_PAIR = ["project_id", "src"]


def import_edges(files: DataFrame) -> DataFrame:
    """(project_id, src, dst): a file and a project file that it imports."""
    modules = files.select(
        "project_id", F.col("rel_path").alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1)))).alias("module"),
    )
    named = files.select(
        "project_id", F.col("rel_path").alias("dst"),
        F.replace(F.regexp_replace("rel_path", r"(?:/__init__)?\.py\z", ""), F.lit("/"), F.lit(".")).alias("module"),
    ).filter(F.col("dst").endswith(".py")).groupBy("project_id", "module").agg(F.min("dst").alias("dst"))
    return skew_join(modules, named, ["project_id", "module"], "inner", ["src"]).filter("src <> dst").select(
        "project_id", "src", "dst"
    )


def connected_groups(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(project_id, rel_path, component): the least path each file is connected to.

    Edges are replaced by stars in alternating rounds: first every node hands
    its larger neighbours to its least one, then its smaller neighbours. That
    takes a logarithmic number of rounds on chains too. Each round aggregates
    before it shuffles, spreads hub nodes over salts, and is kept.
    """
    both = edges.filter("src <> dst").select("project_id", "src", "dst")
    current = kept(both.union(both.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    previous = None
    for _ in range(max_rounds):
        current = kept(_small_star(_large_star(current)))
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("project_id", "src", "dst").cast("decimal(38,0)"))).first()
        if seen == previous:
            break
        previous = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select("project_id", F.col("src").alias("rel_path"), F.col("dst").alias("component"))
    centres = current.select("project_id", F.col("dst").alias("rel_path"), F.col("dst").alias("component"))
    return members.union(centres).distinct()


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*_PAIR).agg(F.least(F.min("dst"), F.col("src")).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node it knows."""
    both = edges.union(edges.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    larger = both.filter("dst > src")
    return skew_join(larger, _least(both), _PAIR, "inner", ["dst"]).select(
        "project_id", F.col("dst").alias("src"), F.col("least").alias("dst")
    ).filter("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    downward = edges.select(
        "project_id", F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    ).distinct()
    least = _least(downward)
    moved = skew_join(downward, least, _PAIR, "inner", ["dst"]).select(
        "project_id", F.col("dst").alias("src"), F.col("least").alias("dst")
    )
    own = least.select("project_id", "src", F.col("least").alias("dst"))
    return moved.union(own).filter("src <> dst").distinct()


def related_files(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every file connected to a seed, in either direction; a seed without edges stands alone."""
    groups = connected_groups(edges)
    wanted = groups.join(seeds.select("project_id", "rel_path").distinct(), ["project_id", "rel_path"], "left_semi")
    hit = wanted.select("project_id", "component").distinct()
    found = skew_join(groups, hit, ["project_id", "component"], "left_semi", ["rel_path"])
    return found.select("project_id", "rel_path").union(seeds.select("project_id", "rel_path")).distinct()
