"""Mixing sources to target shares by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, unit_hash

#: Bins of the random ranks of one source. A source's cut is found from the bins' sums; only the rows of the cut's bin are then put in order.
BINS = 4096
#: Texts of fewer tokens than this get inclusion odds in proportion to their length.
SHORT = 64

#: Listed sources at most, as their rows are sent to all executors.
LISTED = 100_000


def mixture(sizes: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens",
            share_col: str = "target_share", cap_col: str = "max_repeats", total: float | None = None, short: int = SHORT, seed: int = 8) -> DataFrame:
    """(id, source, size, copies): the documents of a mixture in which each source has its share of the total size.

    A document of weight w = min(1, size / short) is expected ``m·w`` times, m being the same within a source and at most its cap, so that
    the expected size is the source's share of the total. It is used floor(m·w) times for certain; of the rest a fixed-size sample with
    unequal probabilities is drawn by Pareto order: documents are ranked by the odds of a random number, which depends on id and seed only,
    over the odds of the fractional part, and taken in that order until the source's remaining size is filled to within half a document.

    ``total`` is the size of the mixture; by default, and at most, the largest that every listed source with any text can fill within its
    cap. Sources that are not listed, or have share 0 or null, contribute nothing; listed sources without text leave their share to the
    others in proportion. Null ids, null sources and sizes below 1 are never used; rows repeated by id count once; ties of rank are put in
    order by id. An empty table gives an empty mixture.

    The one shuffle by id removes repeated rows; all else is sums by source and bin with partial aggregation, of at most BINS rows a
    source, so a source that holds most rows is never gathered in one task. Broadcast: one row a listed source."""
    listed = (targets.where((F.col(share_col) > 0) & (F.col(cap_col) > 0) & F.col(source_col).isNotNull())
              .groupBy(F.col(source_col).alias("_s")).agg(F.sum(share_col).alias("_share"), F.max(cap_col).cast("double").alias("_cap")))
    if listed.count() > LISTED:
        raise ValueError(f"more than {LISTED} listed sources")
    docs = (sizes.where(F.col(id_col).isNotNull() & (F.col(size_col) > 0))
            .select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), F.col(size_col).cast("bigint").alias("_n"))
            .groupBy("_id").agg(F.min(F.struct("_src", "_n")).alias("_r")).select("_id", F.col("_r._src").alias("_src"), F.col("_r._n").alias("_n"))
            .withColumn("_w", F.least(F.lit(1.0), F.col("_n") / F.lit(float(max(short, 1))))))
    docs = keep(docs)
    # as many rows as there are listed sources
    # summed as whole numbers, so that no order of the rows changes the last digits and with them a cut
    least = float(max(short, 1))
    weighed = F.sum((F.least(F.col("_n").cast("double"), F.lit(least)).cast("decimal(18,0)") * F.col("_n").cast("decimal(18,0)")).cast("decimal(38,0)"))
    by_source = (docs.groupBy("_src").agg((weighed.cast("double") / F.lit(least)).alias("_weighed"))
                 .join(F.broadcast(listed), F.col("_src") == F.col("_s")).where(F.col("_weighed") > 0))
    every = Window.partitionBy(F.lit(0))
    plan = by_source.withColumn("_part", F.col("_share") / F.sum("_share").over(every))
    most = F.min(F.col("_cap") * F.col("_weighed") / F.col("_part")).over(every)
    plan = plan.withColumn("_total", most if total is None else F.least(F.lit(float(total)), most))
    plan = plan.select(F.col("_src").alias("_s"), (F.col("_part") * F.col("_total") / F.col("_weighed")).alias("_m"), (F.col("_part") * F.col("_total")).alias("_want"), "_cap")
    u = unit_hash(F.col("_id"), seed=seed)
    expected = F.least(F.col("_m") * F.col("_w"), F.col("_cap"))
    drawn = docs.join(F.broadcast(plan), F.col("_src") == F.col("_s")).drop("_s").withColumn("_whole", F.floor(expected + F.lit(1e-9)).cast("bigint"))
    drawn = drawn.withColumn("_pi", F.greatest(F.lit(0.0), expected - F.col("_whole"))).withColumn("_u", u)
    # order by rank q/(1+q), which lies in (0, 1) and is null where there is no fractional part
    q = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_pi") / (1 - F.col("_pi")))
    drawn = keep(drawn.withColumn("_q", F.when(F.col("_pi") > 1e-9, q / (1 + q))).withColumn("_bin", F.floor(F.col("_q") * BINS).cast("int")))
    bins = drawn.groupBy("_src", "_bin").agg(F.sum(F.when(F.col("_bin").isNotNull(), F.col("_n")).otherwise(0)).alias("_bin_n"),
                                             F.sum(F.col("_whole") * F.col("_n")).alias("_sure"), F.first("_want").alias("_want"))
    ordered = Window.partitionBy("_src").orderBy(F.col("_bin").asc_nulls_first())
    bins = (bins.withColumn("_before", F.sum("_bin_n").over(ordered) - F.col("_bin_n"))
            .withColumn("_rest", F.col("_want") - F.sum("_sure").over(Window.partitionBy("_src"))).where(F.col("_bin").isNotNull()))
    cut = (bins.withColumn("_take", F.when(F.col("_before") + F.col("_bin_n") <= F.col("_rest"), 2).when(F.col("_before") < F.col("_rest"), 1).otherwise(0))
           .select(F.col("_src").alias("_s"), F.col("_bin").alias("_b"), "_before", "_rest", "_take"))
    # the last full bin, and the room left in the bin of the cut
    cuts = (cut.groupBy("_s").agg(F.max(F.when(F.col("_take") == 2, F.col("_b"))).alias("_full"), F.min(F.when(F.col("_take") == 1, F.col("_b"))).alias("_at"),
                                  F.min(F.when(F.col("_take") == 1, F.col("_rest") - F.col("_before"))).alias("_room")))
    placed = drawn.join(F.broadcast(cuts), F.col("_src") == F.col("_s"), "left").drop("_s")
    whole = placed.select("_id", "_src", "_n", (F.col("_whole") + F.when(F.col("_bin") <= F.col("_full"), 1).otherwise(0)).alias("copies"))
    edge = placed.where(F.col("_bin") == F.col("_at"))
    run = Window.partitionBy("_src").orderBy("_q", "_id")
    extra = edge.withColumn("_sum", F.sum("_n").over(run)).where(F.col("_sum") - F.col("_n") / 2 <= F.col("_room")).select("_id", "_src", "_n", F.lit(1).cast("bigint").alias("copies"))
    return (whole.unionByName(extra).where(F.col("copies") > 0).groupBy("_id", "_src", "_n").agg(F.sum("copies").alias("copies"))
            .select(F.col("_id").alias(id_col), F.col("_src").alias(source_col), F.col("_n").alias(size_col), "copies"))


def reached_shares(mixed: DataFrame, targets: DataFrame, *, source_col: str = "source", size_col: str = "n_tokens", share_col: str = "target_share",
                   cap_col: str = "max_repeats") -> DataFrame:
    """(source, target_share, max_repeats, documents, most_copies, tokens, share): what a mixture really holds of each listed source."""
    got = mixed.groupBy(source_col).agg(F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col(size_col)).alias("tokens"))
    listed = targets.where(F.col(source_col).isNotNull()).groupBy(source_col).agg(F.sum(share_col).alias("target_share"), F.max(cap_col).cast("bigint").alias("max_repeats"))
    all_rows = Window.partitionBy(F.lit(0))
    none = F.lit(0).cast("bigint")
    return (listed.join(got, source_col, "left").select(source_col, "target_share", "max_repeats", F.coalesce("documents", none).alias("documents"),
            F.coalesce("most_copies", none).alias("most_copies"), F.coalesce("tokens", none).alias("tokens"))
            .withColumn("share", F.col("tokens") / F.nullif(F.sum("tokens").over(all_rows), F.lit(0))))
