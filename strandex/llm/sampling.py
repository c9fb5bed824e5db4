"""A reproducible sample that only grows: consistent weighted Poisson sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_unit(key: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def inclusions(df: DataFrame, id_col: str, share: float | DataFrame, *, batch_col: str | None = None, weight_col: str | None = None, seed: str = "s1", state: DataFrame | None = None) -> DataFrame:
    """(id, inclusion, selected_at, u) of every id ever delivered: the largest inclusion probability it ever had, and the batch in which it was first
    selected, or null. To be stored and given back as ``state`` of a later run.

    An id is selected when the hash ``u`` of seed and id is below its inclusion probability: weight × constant, the constant of a batch being the
    share over the mean weight of all ids delivered so far. Each id keeps the running maximum of its probability over the batches and over the
    runs, so it never falls, whatever later batches weigh, whatever share a later run has, and also where it gets only the batches that are
    new: what was selected stays selected. Without ``weight_col`` all weights are 1 and the constant is the share itself.

    ``share`` is a number or a one-row frame with one column; a null or missing share selects nothing new. The result depends on the set of
    rows only, not on their order, partitions or repetition. Rows of an id in several batches count from each on; a repeated row counts
    once, and of several weights in one batch the largest counts. Null ids are left out, null batches count as the first, null or
    negative weights as 0. Other columns are ignored. Of a state only ids that are not null count.

    One shuffle by id; the driver gets the sums of each batch (one row a batch delivered)."""
    batch = F.coalesce(F.col(batch_col), F.lit(-(1 << 31))).cast("bigint") if batch_col else F.lit(0).cast("bigint")
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), batch.alias("_batch"), weight.alias("_w")).groupBy("_id", "_batch").agg(F.max("_w").alias("_w"))
    if isinstance(share, DataFrame):
        share = share.agg(F.max(F.col(share.columns[0]).cast("double"))).first()[0] or 0.0
    # the mean weight up to each batch: an id counts from its first batch with its largest weight so far
    of_id = Window.partitionBy("_id").orderBy("_batch")
    runs = rows.withColumn("_top", F.max("_w").over(of_id)).withColumn("_step", F.col("_top") - F.coalesce(F.lag("_top").over(of_id), F.lit(0.0))).withColumn("_new", F.when(F.row_number().over(of_id) == 1, 1).otherwise(0))
    sums = {r["_batch"]: (r["_sw"], r["_n"]) for r in runs.groupBy("_batch").agg(F.sum("_step").alias("_sw"), F.sum("_new").alias("_n")).collect()}
    constants, total, count = [], 0.0, 0
    for b in sorted(sums):
        total, count = total + sums[b][0], count + sums[b][1]
        constants.append((b, float(share) / (total / count) if total else 0.0))
    # from each of its batches to the next, an id's weight is the largest so far; the constant may rise in between, so all of those batches count
    table = F.array(*[F.struct(F.lit(b).cast("bigint").alias("b"), F.lit(c).alias("c")) for b, c in constants]) if constants else F.array().cast("array<struct<b:bigint,c:double>>")
    until = F.coalesce(F.lead("_batch").over(of_id), F.lit(1 << 62))
    spans = runs.select("_id", "_batch", "_top", until.alias("_until"), md5_unit(F.concat_ws("|", F.lit(seed), F.col("_id").cast("string"))).alias("_u"))
    spans = spans.withColumn("_at", F.transform(F.filter(table, lambda x: (x["b"] >= F.col("_batch")) & (x["b"] < F.col("_until"))), lambda x: F.struct(x["b"].alias("b"), F.least(F.lit(1.0), F.col("_top") * x["c"]).alias("p"))))
    spans = spans.select("_id", "_u", F.array_max(F.transform("_at", lambda x: x["p"])).alias("_p"), F.array_min(F.transform(F.filter("_at", lambda x: F.col("_u") < x["p"]), lambda x: x["b"])).alias("_sel"), F.lit(None).cast("bigint").alias("_held"))
    if state is not None:
        held = state.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(df.schema[id_col].dataType).alias("_id"), md5_unit(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"))).alias("_u"), F.col("inclusion").cast("double").alias("_p"), F.lit(None).cast("bigint").alias("_sel"), F.col("selected_at").cast("bigint").alias("_held"))
        spans = spans.unionByName(held)
    return (spans.groupBy("_id").agg(F.coalesce(F.max("_p"), F.lit(0.0)).alias("inclusion"), F.coalesce(F.min("_held"), F.min("_sel")).alias("selected_at"), F.first("_u").alias("u"))
            .select(F.col("_id").alias(id_col), "inclusion", "selected_at", "u"))


def consistent_sample(df: DataFrame, id_col: str, share: float | DataFrame, *, batch_col: str | None = None, weight_col: str | None = None, seed: str = "s1", state: DataFrame | None = None) -> DataFrame:
    """(id, inclusion, selected_at, u): the ids that are selected, with the batch in which each first was; see :func:`inclusions`."""
    return inclusions(df, id_col, share, batch_col=batch_col, weight_col=weight_col, seed=seed, state=state).where(F.col("selected_at").isNotNull())
