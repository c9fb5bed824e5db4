"""Inventory of documents and their jobs: latest rows, counts, states, pages of results."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clauses import RequestError


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: str | None = None) -> DataFrame:
    """One row for each key: the one that ``order`` puts last. ``count`` names a column for the number of rows.

    An aggregate with partial results, not a window: of a hot key each task sends one row. ``order`` must tell all rows of a key apart."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r")
    more = [F.count(F.lit(1)).alias(count)] if count else []
    return df.groupBy(*keys).agg(best, *more).select(*keys, "_r.*", *([count] if count else []))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows of each key in order: what pruning of a history keeps."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def summary(jobs: DataFrame, by: Sequence[str], state: str, states: Sequence[str], when: str, document: str, failed: str) -> DataFrame:
    """For each group the number of jobs in each state, of all, the next time of a retry, and of documents with a failure."""
    counts = [F.count_if(F.col(state) == s).alias(f"n_{s}") for s in states]
    return jobs.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts, F.min(F.when(F.col(state) == "retry_wait", F.col(when))).alias("next_retry"), F.count_distinct(F.when(F.col(state) == failed, F.col(document))).alias("failed_documents"))


def value_counts(df: DataFrame, col: Column, name: str) -> DataFrame:
    """How often each value stands, the most frequent first, equal ones by value."""
    return df.groupBy(col.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(name))


def histogram(df: DataFrame, keys: Sequence[str], col: str, into: str) -> DataFrame:
    """A map from each value of a column to its count, by key. Counted before it is gathered, so a key's map is as long as it has values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(col, "_n")))).alias(into))


def document_status(job: Column, errors: Column, available: Column) -> Column:
    """State shown for a document: its open job's, else an error, else whether it can be searched."""
    return (F.when(job == "running", "indexing").when(job.isin("queued", "retry_wait"), "pending").when((job == "failed") | (errors > 0), "error")
            .when(~F.coalesce(available, F.lit(True)), "unavailable").otherwise("ready"))


def retry_delay_seconds(attempt: Column) -> Column:
    """5 s, 30 s, 2 min, 10 min, then an hour; no delay, and no retry, after the fifth attempt."""
    return F.when(attempt <= 1, 5).when(attempt == 2, 30).when(attempt == 3, 120).when(attempt == 4, 600).when(attempt == 5, 3600)


def fail_job(state: Column, attempt: Column, retryable: Column, now: Column) -> tuple[Column, Column]:
    """(state, time of the next try) of a running job that failed."""
    again = retryable & (attempt <= 5)
    seconds = F.coalesce(retry_delay_seconds(attempt), F.lit(0))
    return F.when(state != "running", state).when(again, F.lit("retry_wait")).otherwise(F.lit("failed")), F.when(again & (state == "running"), now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


def merge_open_jobs(requests: DataFrame, document: str, kind: str, time: str) -> DataFrame:
    """One open job a document: the earliest request's time, and the kind that does most of those asked for: ``reindex``, ``index``, ``refresh``."""
    weight = F.max(F.when(F.col(kind) == "reindex", 2).when(F.col(kind) == "refresh", 0).otherwise(1))
    return requests.groupBy(document).agg(F.min(time).alias(time), F.when(weight == 2, F.lit("reindex")).when(weight == 1, F.lit("index")).otherwise(F.lit("refresh")).alias(kind), F.count(F.lit(1)).alias("requests"))


def missing(known: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known rows that a listing no longer has."""
    return known.join(listed.select(*keys).distinct(), list(keys), "left_anti")


def renames(gone: DataFrame, new: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """(old, new): rows that vanished and rows that appeared with one content, where the content leaves no choice on either side."""
    single = lambda df, name: df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(id_col).alias(name), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return single(gone, "old").join(single(new, "new"), hash_col).select("old", "new")


def context_window(rows: DataFrame, anchors: DataFrame, content: str, ordinal: str, before: int, after: int) -> DataFrame:
    """The anchors' neighbours in their content, each once. Anchors are spread to the ordinals wanted, so the join is on equality and a long
    content is not paired with itself."""
    if not (0 <= before <= 3 and 0 <= after <= 3):
        raise RequestError("invalid_context", "0 to 3 rows on either side")
    wanted = anchors.select(content, F.explode(F.sequence(F.col(ordinal) - before, F.col(ordinal) + after)).alias(ordinal)).distinct()
    return rows.join(wanted, [content, ordinal], "left_semi")


def span_members(spans: DataFrame, members: DataFrame, section: str, start: str, end: str, offset: str, length: str) -> DataFrame:
    """Spans of a section with the members that they overlap."""
    s, m = spans.alias("s"), members.alias("m")
    return s.join(m, (F.col(f"s.{section}") == F.col(f"m.{section}")) & (F.col(f"s.{start}") < F.col(f"m.{offset}") + F.col(f"m.{length}")) & (F.col(f"s.{end}") > F.col(f"m.{offset}"))).drop(F.col(f"m.{section}"))


# Filters


def under(path: Column, prefix: str) -> Column:
    """Whether a path is a prefix or lies under it."""
    p = prefix.rstrip("/\\")
    return (path == p) | path.startswith(p + "/") | path.startswith(p + "\\")


def extension(name: Column) -> Column:
    """The extension with its dot, in lower case; ``.tar.gz`` counts as one."""
    low = F.lower(name)
    return F.when(low.endswith(".tar.gz"), ".tar.gz").otherwise(F.regexp_extract(low, r"(\.[^./\\]+)$", 1))


def search_filter(paths: Sequence[str] = (), extensions: Sequence[str] = (), modified: tuple[Any, Any] | None = None, documents: Sequence[Any] = (), attachments: str = "any", *,
                  path: str = "source_path", name: str = "file_name", time: str = "modified_utc", document: str = "document_id", depth: str | None = None) -> Column:
    """The filters of a search as one condition; an empty list does not filter."""
    out = F.lit(True)
    if documents:
        out = out & F.col(document).isin(*documents)
    if paths:
        some = F.lit(False)
        for p in paths:
            some = some | under(F.col(path), p)
        out = out & some
    if extensions:
        bad = [e for e in extensions if not _EXTENSION.fullmatch(e)]
        if bad:
            raise RequestError("invalid_extension", ", ".join(bad))
        some = F.lit(False)
        for e in extensions:
            some = some | F.lower(F.col(name)).endswith(e.lower())
        out = out & some
    if modified:
        low, high = modified
        if low is not None:
            out = out & (F.col(time) >= F.lit(low))
        if high is not None:
            out = out & (F.col(time) <= F.lit(high))
    if attachments != "any" and depth:
        out = out & (F.col(depth) == 0 if attachments == "roots" else F.col(depth) > 0)
    return out


_EXTENSION = re.compile(r"(?=.{2,32}\Z)\.[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*")


# Pages


def keyset_page(df: DataFrame, keys: Sequence[tuple[str, bool]], after: Sequence[Any] | None, limit: int) -> DataFrame:
    """The page of ``limit`` + 1 rows that follow a row's key values, in an order of (column, ascending) keys that tells all rows apart.

    Nulls come first in ascending order and last in descending order. The extra row says that there is another page. The condition is a filter
    and the plan takes the first rows of each task, so a page costs one pass whatever its number."""
    order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys]
    if after is not None:
        beyond = F.lit(False)
        same = F.lit(True)
        for (c, up), v in zip(keys, after, strict=True):
            col, v = F.col(c), None if v is None else F.lit(v).cast(df.schema[c].dataType)  # of the column's type, so that it reaches the scan
            if v is None:
                later = col.isNotNull() if up else F.lit(False)
                equal = col.isNull()
            else:
                later = col > v if up else (col < v) | col.isNull()
                equal = col == v
            beyond = beyond | (same & later)
            same = same & equal
        df = df.where(beyond)
    return df.orderBy(*order).limit(limit + 1)


def offset_page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def encode_cursor(filters: Mapping[str, Any], generation: int, after: Sequence[Any]) -> str:
    """A cursor bound to the filters and the generation it was made for."""
    mark = hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps([1, mark, generation, list(after)], default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, filters: Mapping[str, Any], generation: int) -> list[Any]:
    try:
        version, mark, made, after = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (ValueError, TypeError) as e:
        raise RequestError("invalid_cursor", "not a cursor") from e
    if version != 1 or mark != hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:16]:
        raise RequestError("invalid_cursor", "made for other filters")
    if made != generation:
        raise RequestError("stale_cursor", "the index has changed")
    return after


def processing_times(events: DataFrame, keys: Sequence[str], job: str, state: str, time: str, waiting: Sequence[str] = ("waiting",), ended: str = "completed") -> DataFrame:
    """(keys, jobs, average_seconds): the mean time that ended jobs were worked on, from a log of their states.

    A state lasts until the job's next one; states of ``waiting`` and what comes before the first or after the last don't count."""
    w = Window.partitionBy(job).orderBy(time, state)
    each = events.withColumn("_until", F.lead(time).over(w)).withColumn("_s", F.when(~F.col(state).isin(*waiting), F.unix_micros(F.col("_until").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))))
    jobs = each.groupBy(*keys, job).agg(F.sum("_s").alias("_s"), F.max(F.col(state) == ended).alias("_done")).where("_done")
    return jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("jobs"), (F.avg(F.coalesce("_s", F.lit(0))) / 1e6).alias("average_seconds"))
