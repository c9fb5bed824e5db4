"""Groups of related records by alternating star contraction, and splits that keep them together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep
from .sampling import md5_unit

#: Edges of one node are spread over this many parts, so no task gets more than that part of a node's edges.
SALT = 64
#: Author names that name nobody (fixed values).
PLACEHOLDERS = ("", "unknown", "n/a", "na", "none", "null", "anonymous", "anon", "-", "--", "?", "??", "tbd", "nobody", "not available", "unbekannt")


def with_minimum(edges: DataFrame, by: str, of: str, into: str) -> DataFrame:
    """edges with the least ``of`` among the edges of the same ``by``, in ``into``.

    Each edge belongs to one of SALT parts of its ``by`` by the hash of its other end. The minimum is taken by part, then over the parts,
    and goes back to the parts that exist, so a node with a third of all edges is spread over SALT tasks and one with few costs no more."""
    parts = edges.withColumn("_part", F.pmod(F.xxhash64(of), F.lit(SALT)).cast("byte"))
    least = (parts.groupBy(by, "_part").agg(F.min(of).alias("_least")).groupBy(by).agg(F.min("_least").alias(into), F.collect_set("_part").alias("_parts"))
             .select(by, into, F.explode("_parts").alias("_part")))
    return parts.join(least, [by, "_part"]).drop("_part")


def settled(ends: DataFrame) -> bool:
    """Whether edges (u, v) are stars: no node has two parents, none is a child and a parent. One aggregation with partial sums."""
    nodes = ends.select(F.col("u").alias("x"), F.col("v").alias("p"), F.lit(False).alias("c")).unionByName(ends.select(F.col("v").alias("x"), F.lit(None).cast(ends.schema["v"].dataType).alias("p"), F.lit(True).alias("c")))
    odd = nodes.groupBy("x").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.max("c").alias("c")).where((F.col("low") != F.col("high")) | (F.col("low").isNotNull() & F.col("c")))
    return odd.limit(1).count() == 0


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of the edges the least node of its component, by alternating large-star and small-star steps.

    ``a`` and ``b`` have one comparable type. Loops, repeated and null-ended edges link nothing. Rounds are logarithmic in the components'
    diameter; each cuts its lineage by a checkpoint in the shared folder, and the last is known by one aggregation."""
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    ends = cut(ends)
    for _ in range(max_rounds):
        if settled(ends):
            break
        # large star: of each node's neighbours the larger ones move to the least of node and neighbours
        both = ends.select("u", "v").unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_minimum(both, "u", "v", "m").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: the smaller neighbours and the node itself move to the least neighbour
        low = with_minimum(large, "u", "v", "m")
        small = low.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        ends = cut(small)
    else:
        raise RuntimeError("components did not settle")
    return ends.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def related_groups(records: DataFrame, id_col: str, entities: list[DataFrame], links: list[DataFrame] = ()) -> DataFrame:
    """(id, group): for every record the least id of its group; groups join records that share an entity or are linked.

    entities: frames (id, key) with one entity key a row, keys of one frame being of one kind; links: frames (a, b) of two ids, both of
    which must be records. Null ids and keys relate nothing. A record related to no other is its own group.

    Each entity is first contracted to links from its records to its least record, with partial aggregation, so an entity shared by a third
    of all records makes a third of the records one link each and is never gathered."""
    ids = keep(records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct())
    pairs: list[DataFrame] = []
    for e in entities:
        i, key = e.columns
        e = e.where(F.col(i).isNotNull() & F.col(key).isNotNull()).select(F.col(i).alias("_id"), F.col(key).alias("_key")).distinct().join(ids, "_id", "left_semi")
        pairs.append(with_minimum(e, "_key", "_id", "_least").select(F.col("_id").alias("a"), F.col("_least").alias("b")))
    for x in links:
        i, j = x.columns
        x = x.where(F.col(i).isNotNull() & F.col(j).isNotNull()).select(F.col(i).alias("a"), F.col(j).alias("b"))
        pairs.append(x.join(ids.select(F.col("_id").alias("a")), "a", "left_semi").join(ids.select(F.col("_id").alias("b")), "b", "left_semi").select("a", "b"))
    if not pairs:
        return ids.select(F.col("_id").alias(id_col), F.col("_id").alias("group_id"))
    found = connected_components(reduce(DataFrame.unionByName, pairs), "a", "b")
    return ids.join(found, F.col("_id") == F.col("node"), "left").select(F.col("_id").alias(id_col), F.coalesce("component", "_id").alias("group_id"))


def author_key(author: Column) -> Column:
    """The author without case and outer blanks; null where blank or a placeholder."""
    key = F.lower(F.regexp_replace(author, r"^[\s ]+|[\s ]+$", ""))
    return F.when(~key.isin(*PLACEHOLDERS), key)


def assign_splits(groups: DataFrame, group_col: str, targets: DataFrame, seed: str = "split-1") -> DataFrame:
    """groups with a column ``split``: the range of [0, 1) in which the hash of the row's group id falls.

    The ranges follow from the targets alone, in the order of their names, so a group keeps its split whatever else is added and however large it
    or others grow. Whole groups are hashed: a group with a part of all rows moves the splits' sizes by up to that part, so shares are met
    as closely as the largest groups are small. Shares are scaled to sum to 1; targets of one name count together; without any the split is
    null. Rows with a null group get no split."""
    shares = [(r["target_name"], r["s"]) for r in targets.where((F.col("target_share") > 0) & F.col("target_name").isNotNull()).groupBy("target_name").agg(F.sum("target_share").alias("s")).collect()]
    if not shares:
        return groups.withColumn("split", F.lit(None).cast("string"))
    whole = sum(s for _, s in shares)
    u = md5_unit(F.concat_ws("|", F.lit(seed), F.col(group_col).cast("string")))
    split, high = None, 0.0
    for name, share in sorted(shares)[:-1]:
        high += share / whole
        split = F.when(u < high, F.lit(name)) if split is None else split.when(u < high, F.lit(name))
    last = F.lit(sorted(shares)[-1][0])
    return groups.withColumn("split", F.when(F.col(group_col).isNotNull(), last if split is None else split.otherwise(last)))
