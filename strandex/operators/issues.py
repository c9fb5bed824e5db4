"""Issues of indexing: grouped by document, hidden and restored by signature, with a history of their occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import issue_cause, issue_signature


def with_signature(errors: DataFrame, document: str, code: str, component: str, message: str) -> DataFrame:
    """errors with ``signature``: the same for the same cause in the same document, whatever the time."""
    return errors.withColumn("signature", issue_signature(F.col(document).cast("string"), F.col(code), F.col(component), issue_cause(F.col(component), F.col(message)), F.lit("")))


def impact(failed: Column, degraded: Column) -> Column:
    """3: nothing of the document can be found; 2: a part is missing; 1: a note."""
    return F.when(failed, 3).when(degraded, 2).otherwise(1)


def groups(errors: DataFrame, root: str, weight: Column, failed: Column, degraded: Column, latest: str) -> DataFrame:
    """One row a document: number of issues, the greatest weight, the latest time and the impact."""
    return errors.groupBy(root).agg(F.count(F.lit(1)).alias("issues"), F.max(weight).alias("weight"), F.max(latest).alias("latest"), impact(F.max(failed.cast("int")) == 1, F.max(degraded.cast("int")) == 1).alias("impact"))


def unacknowledged(errors: DataFrame, acknowledgements: DataFrame, keys: list[str]) -> DataFrame:
    """Issues that have not been hidden, counted by signature."""
    return errors.join(acknowledgements.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def totals(errors: DataFrame, condition: Column) -> DataFrame:
    """One row: issues and documents, of all and of those that a filter keeps, in one pass."""
    return errors.agg(F.count(F.lit(1)).alias("all_issues"), F.count_if(condition).alias("shown_issues"))


def upsert_lifecycles(known: DataFrame | None, errors: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(keys, first_seen, last_seen, occurrences): the history after more errors."""
    new = errors.groupBy(*keys).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count(F.lit(1)).alias("occurrences"))
    if known is None:
        return new
    both = known.select(*keys, "first_seen", "last_seen", "occurrences").unionByName(new)
    return both.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrences").alias("occurrences"))


def prune_lifecycles(lifecycles: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """The histories of issues that still exist."""
    return lifecycles.join(errors.select(*keys).distinct(), keys, "left_semi")
