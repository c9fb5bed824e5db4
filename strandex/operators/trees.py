"""Trees of content: attachments inside files and what they hold in turn."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Depth to which content is opened; a tree is expanded by as many joins.
MAX_DEPTH = 5


def sibling_occurrences(nodes: DataFrame, parent: str, keys: list[str], ordinal: str, into: str = "occurrence") -> DataFrame:
    """Numbers, from 0, the siblings that share a key, in order."""
    return nodes.withColumn(into, F.row_number().over(Window.partitionBy(parent, *keys).orderBy(ordinal)) - 1)


def expand(nodes: DataFrame, id_col: str, parent_col: str, name_col: str, ordinal_col: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Each node that can be reached from a root, with ``depth``, ``path`` (ids from the root), ``chain`` (names below the root) and
    ``sort_path`` (ordinals, so that sorting by it gives the preorder).

    Level by level: each join adds the children of the last level's nodes, so every node is made once. Deeper nodes and those of cycles are
    not reached."""
    here = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(name_col).alias("name"), F.format_string("%08d", F.col(ordinal_col).cast("int")).alias("ord"))
    level = here.where(F.col("parent").isNull()).select("id", "parent", "name", F.lit(0).alias("depth"), F.array("id").alias("path"), F.array().cast("array<string>").alias("chain"), F.col("ord").alias("sort_path"))
    out = level
    for depth in range(1, max_depth + 1):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("_p"), F.col("chain").alias("_c"), F.col("sort_path").alias("_s"))
        level = here.where(F.col("parent").isNotNull()).join(up, "parent").select("id", "parent", "name", F.lit(depth).alias("depth"), F.concat("_p", F.array("id")).alias("path"), F.concat("_c", F.array("name")).alias("chain"), F.concat_ws(".", "_s", "ord").alias("sort_path"))
        out = out.unionByName(level)
    return out


def descendants(expanded: DataFrame) -> DataFrame:
    """(id, descendants) of each node that has any."""
    return expanded.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("descendants"))


def recursive_ancestors(nodes: DataFrame, id_col: str, parent_col: str, start: DataFrame | None = None) -> DataFrame:
    """(id, ancestor, steps) of all nodes or of those of ``start``, one row for each way up, whatever the depth and the number of rows.

    Ways are found on the nodes that have children only, by doubling: those of exactly ``reach`` steps go on over all ways known, until there are
    none. Leaves meet them in one join. A cycle among the nodes, over which there is no last way, raises a ValueError."""
    edges = nodes.where(F.col(parent_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(parent_col).alias("ancestor"))
    lowest = edges if start is None else edges.join(start.select(F.col(id_col).alias("id")), "id", "left_semi")
    inner = edges.join(edges.select(F.col("ancestor").alias("id")).distinct(), "id", "left_semi")
    ways, reach = [inner.withColumn("steps", F.lit(1)).persist(StorageLevel.MEMORY_AND_DISK)], 1
    while True:
        found = ways[-1].agg(F.count_if(F.col("steps") == reach).alias("far"), F.count_if(F.col("id") == F.col("ancestor")).alias("round")).first()
        if found["round"]:
            raise ValueError("the nodes form a cycle")
        known = reduce(DataFrame.unionByName, ways).select(F.col("id").alias("_via"), F.col("ancestor").alias("_top"), "steps")
        if not found["far"]:
            break
        far = ways[-1].where(F.col("steps") == reach).select("id", F.col("ancestor").alias("_via"))
        ways.append(far.join(known, "_via").select("id", F.col("_top").alias("ancestor"), (F.col("steps") + reach).alias("steps")).persist(StorageLevel.MEMORY_AND_DISK))
        reach *= 2
    further = lowest.withColumnRenamed("ancestor", "_via").join(known, "_via").select("id", F.col("_top").alias("ancestor"), (F.col("steps") + 1).alias("steps"))
    return lowest.withColumn("steps", F.lit(1)).unionByName(further)
