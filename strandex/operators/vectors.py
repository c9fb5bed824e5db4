"""Exact vector search, vector functions and checks of stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector_top_k(rows: DataFrame, query: Sequence[float], k: int, id_col: str, vector_col: str, condition: Column | None = None, digits: int = 6) -> DataFrame:
    """(id, score): the k rows nearest to a query by dot product, the least id first among equal ones.

    The filter comes before the ranking. Rows whose vector is null or of another length are left out. The plan keeps k rows in each task and k
    at the end; nothing else is shuffled."""
    q = F.array(*[F.lit(float(x)) for x in query])
    kept = rows if condition is None else rows.where(condition)
    scored = kept.where(F.size(vector_col) == len(query)).select(id_col, F.round(dot(F.col(vector_col), q), digits).alias("score"))
    return scored.orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def vector_top_k_many(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, digits: int = 6, block: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of each of a set of queries, a frame of ids and vectors, against all rows.

    Queries go to the tasks in blocks of about ``block``, by the hash of their ids; the driver holds one block at a time, and the rows are read once for
    each. A task folds its batches into the k best of each query of the block, and only these are shuffled. Null vectors, and those of
    another length than the query's, are left out; repeated query ids count once."""
    kind = rows.schema[id_col].dataType.simpleString()
    asked = queries.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("query_id")).agg(F.first(vector_col).alias("v"))
    blocks = max(1, -(-asked.count() // block))
    best = None
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        for size in sorted({len(r["v"]) for r in held}):
            found = _nearest(rows.select(id_col, vector_col).where(F.size(vector_col) == size), [(r["query_id"], r["v"]) for r in held if len(r["v"]) == size], k, id_col, vector_col, kind, digits)
            best = found if best is None else best.unionByName(found)
    if best is None:
        best = rows.sparkSession.createDataFrame([], f"query_id bigint, {id_col} {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(rows: DataFrame, queries: list[tuple], k: int, id_col: str, vector_col: str, kind: str, digits: int) -> DataFrame:
    """The k best rows of each task for each query of one block."""
    ids = [q for q, _ in queries]
    matrix = np.array([v for _, v in queries], np.float64).T

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, names = np.empty((0, len(ids))), None  # the best so far, one column a query
        for part in parts:
            if not len(part):
                continue
            new = np.round(np.stack(part[vector_col].to_numpy()).astype(np.float64) @ matrix, digits)
            own = np.broadcast_to(np.array(part[id_col].tolist())[:, None], new.shape)
            scores, names = (new, own) if names is None else (np.concatenate([scores, new]), np.concatenate([names, own]))
            order = np.lexsort((names, -scores), axis=0)[:k]
            scores, names = np.take_along_axis(scores, order, 0), np.take_along_axis(names, order, 0)
        if names is not None:
            for j, q in enumerate(ids):
                yield pd.DataFrame({"query_id": q, id_col: names[:, j].tolist(), "score": scores[:, j]})

    return rows.mapInPandas(run, f"query_id bigint, {id_col} {kind}, score double")


def hashing_embedder(dimension: int = 64):
    """A deterministic stand-in for a model: signed hashes of tokens, at length 1. For tests and for tables without vectors."""
    from zlib import crc32

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dimension, np.float32)
            for w in tokens(t):
                h = crc32(w.encode())
                v[h % dimension] += 1.0 if h >> 16 & 1 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return run


def coverage(passages: DataFrame, vectors: DataFrame, passage_id: str, vector_id: str, vector_col: str, dimension: int, by: Sequence[str] = ()) -> DataFrame:
    """How many passages have a compatible vector: total, with any vector, compatible, distinct vectors, and a status."""
    good = vectors.select(F.col(vector_id).alias("_v"), (F.size(vector_col) == dimension).alias("_ok"), F.col(vector_col).alias("_vec"))
    j = passages.join(good, F.col(passage_id) == F.col("_v"), "left")
    out = j.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count("_v").alias("with_vector"), F.sum(F.when(F.col("_ok"), 1).otherwise(0)).alias("compatible"), F.count_distinct(F.xxhash64("_vec")).alias("distinct_vectors"), F.min(F.size("_vec")).alias("least_length"))
    status = F.when(F.col("compatible") == 0, "none").when(F.col("compatible") == F.col("total"), "complete").otherwise("partial")
    return out.withColumn("status", status)


def identical_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vector_hash, n, first_id): vectors stored more than once, by hash with partial counts."""
    h = F.sha2(F.concat_ws(",", F.transform(vector_col, lambda x: x.cast("string"))), 256)
    return rows.where(F.col(vector_col).isNotNull()).groupBy(h.alias("vector_hash")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def in_batches(texts: Sequence[str], embed: Callable[[list[str]], Sequence], size: int = 32) -> list:
    """The vectors of texts in their order, made in batches of texts of about one length. A batch that runs out of memory is halved, and so are those
    after it; a single text that does raises the error."""
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
    out: list = [None] * len(texts)
    at = 0
    while at < len(order):
        part = order[at : at + size]
        try:
            made = embed([texts[i] for i in part])
        except MemoryError:
            if len(part) == 1:
                raise
            size = max(1, len(part) // 2)
            continue
        for i, v in zip(part, made, strict=True):
            out[i] = v
        at += len(part)
    return out
