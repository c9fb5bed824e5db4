"""The text index: postings of rows of text, and clauses, their counts and BM25 from them instead of from the texts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clauses import Clause
from .ranking import B, K1, idf

def index_rows(rows: DataFrame, scope: str, id_col: str, fields: Mapping[str, str], carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(scope, id, field, term, positions) and (scope, id, carry, length) of rows, one an id, whose ``fields`` are columns of canonical text.

    Null fields are empty; a row without any text has a length of 0 and no postings. A row's terms are counted where the row is; nothing is shuffled."""
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda w: w != "")
    key = [F.lit(scope).alias("scope"), F.col(id_col).cast("string").alias("id")]
    names = list(fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first in range(0, len(part), 1000):
                some = part.slice(first, 1000)
                for k, name in enumerate(names):
                    listed = some.column(f"w{k}")
                    sizes = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
                    coded = listed.flatten().dictionary_encode()
                    if not len(coded):
                        continue
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    at = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                    pair = row * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(pair, kind="stable")
                    one, starts = np.unique(pair[order], return_index=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([scope] * len(one), pa.string()), some.column("id").take(pa.array(one // len(coded.dictionary))), pa.array([name] * len(one), pa.string()),
                        coded.dictionary.take(pa.array(one % len(coded.dictionary))), pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(at[order])),
                    ], ["scope", "id", "field", "term", "positions"])

    postings = rows.select(key[1], *[words(c).alias(f"w{k}") for k, c in enumerate(fields.values())]).mapInArrow(run, "scope string, id string, field string, term string, positions array<int>")
    return postings, rows.select(*key, *carry, sum((F.size(words(c)) for c in fields.values()), F.lit(0)).cast("bigint").alias("length"))


def sought(clauses: Sequence[Clause]) -> tuple[list[str], list[str]]:
    """The terms and the prefixes that clauses look up."""
    terms = {w for c in clauses if c.match != "prefix" for w in c.words}
    return sorted(terms), sorted({c.words[0] for c in clauses if c.match == "prefix" and c.words})


def clause_counts(postings: DataFrame, clauses: Sequence[Clause], keys: Sequence[str] = ("id",)) -> DataFrame:
    """(keys, counts): how often each clause stands in each field of each row in which any does, as a map from ``clause number|field``.

    A phrase stands where its words follow each other; occurrences that share words count once. The postings of the clauses' terms are
    shuffled once, by row and field; rows without any are never met."""
    slots = []
    for i, c in enumerate(clauses):
        for k, w in enumerate(c.words if c.match == "phrase" else c.words[:1]):
            hit = F.col("term").startswith(w) if c.match == "prefix" else F.col("term") == w
            slots.append(F.when(hit & F.col("field").isin(*c.searched), F.struct(F.lit(i).alias("clause"), F.lit(k).alias("slot"))))
    if not slots:
        return postings.limit(0).select(*keys, F.create_map().cast("map<string,int>").alias("counts"))
    sizes = F.array(*[F.lit(len(c.words) if c.match == "phrase" else 1) for c in clauses])
    prefix = F.array(*[F.lit(c.match == "prefix") for c in clauses])
    met = postings.select(*keys, "field", "positions", F.explode(F.array_compact(F.array(*slots))).alias("s")).select(*keys, "field", "positions", "s.*")
    rows = met.groupBy(*keys, "field", "clause").agg(F.array_sort(F.collect_list(F.struct("slot", "positions"))).alias("x"))
    n = sizes[F.col("clause")]
    starts = F.aggregate("x", F.col("x")[0]["positions"], lambda held, y: F.array_intersect(held, F.transform(y["positions"], lambda p: p - y["slot"])))
    apart = F.aggregate(F.array_sort(starts), F.struct(F.lit(-1).alias("free"), F.lit(0).alias("n")), lambda a, p: F.when(p >= a["free"], F.struct((p + n).alias("free"), (a["n"] + 1).alias("n"))).otherwise(a))["n"]
    every = F.aggregate("x", F.lit(0), lambda a, y: a + F.size(y["positions"]))
    count = F.when(prefix[F.col("clause")], every).when(F.size("x") == n, F.when(n > 1, apart).otherwise(every)).otherwise(0)
    counted = rows.select(*keys, F.concat_ws("|", F.col("clause").cast("string"), "field").alias("k"), count.alias("n")).where("n > 0")
    return counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"))


def counted(clauses: Sequence[Clause], i: int, field: str):
    """The count of a clause in a field, 0 where it isn't in the map ``counts``."""
    return F.coalesce(F.element_at("counts", F.lit(f"{i}|{field}")), F.lit(0))


def clause_hits(clauses: Sequence[Clause]) -> dict:
    """For each clause's id whether it stands in any of its fields, from the map ``counts``; never null."""
    out = {}
    for i, c in enumerate(clauses):
        hit = F.lit(False)
        for f in c.searched:
            hit = hit | (counted(clauses, i, f) > 0)
        out[c.id] = hit
    return out


def bm25_counts(rows: DataFrame, clauses: Sequence[Clause], weights: Mapping[str, float], n: int, average: float):
    """The BM25 score of rows (counts, length) as a column. Document frequencies are counted over ``rows``, which hold every row with a match;
    ``n`` and ``average`` are of all rows."""
    phrases = [(i, f) for i, c in enumerate(clauses) if c.occur != "must_not" for f in c.searched if weights.get(f, 0) > 0]
    found = rows.agg(F.lit(0).alias("_"), *[F.sum((counted(clauses, i, f) > 0).cast("int")).alias(f"d{k}") for k, (i, f) in enumerate(phrases)]).first()
    score = F.lit(0.0)
    for k, (i, f) in enumerate(phrases):
        tf = counted(clauses, i, f) * F.lit(float(weights[f]))
        score = score + F.lit(idf(n, found[f"d{k}"] or 0)) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(average or 1.0)))
    return score
