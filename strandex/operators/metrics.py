"""Quality of retrieval and extraction: ranking metrics, page judgments, error rates, paired comparison, fixed partitions."""

from __future__ import annotations

import math
import random
import re

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import union_area


def ranking_metrics(ranked: DataFrame, judged: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, recall, reciprocal_rank, ndcg, relevant) of each judged query at k.

    ranked: (query, item, rank from 1), judged: (query, item, gain). Gains count as they are, of several judgments of an item the largest; gain
    0 is not relevant. Of an item ranked twice the better rank counts. Queries without relevant items have no row."""
    gold = judged.where(F.col("gain") > 0).groupBy(query, item).agg(F.max("gain").cast("double").alias("gain"))
    best = gold.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.col("gain").desc(), item)))
    ideal = best.groupBy(query).agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("_r") <= k, F.col("gain") / F.log2(F.col("_r") + 1.0))).alias("_ideal"))
    got = ranked.groupBy(query, item).agg(F.min("rank").alias("rank")).where(F.col("rank") <= k).join(gold, [query, item])
    found = got.groupBy(query).agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_first"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("_dcg"))
    out = ideal.join(found, query, "left")
    return out.select(query, F.coalesce(F.col("_n") / F.col("relevant"), F.lit(0.0)).alias("recall"), F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("_dcg") / F.col("_ideal"), F.lit(0.0)).alias("ndcg"), "relevant")


def rank_pages(anchors: DataFrame, query: str, page: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Pages in the order of their best anchor, each once, with ``rank``."""
    best = anchors.withColumn("_o", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    pages = best.groupBy(query, *page).agg(F.min("_o").alias("_o"))
    return pages.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("_o"))).drop("_o")


def coverage_of_boxes(gold: Sequence[Sequence[float]], predicted: Sequence[Sequence[float]], threshold: float = 0.5) -> tuple[float, float, int, int]:
    """(gold area, covered area, gold boxes, boxes covered by at least the threshold) of one page; boxes are (left, top, right, bottom)."""

    def cross(a: Sequence[float], b: Sequence[float]) -> tuple[float, float, float, float] | None:
        r = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
        return r if r[2] > r[0] and r[3] > r[1] else None

    gold = [tuple(g) for g in dict.fromkeys(map(tuple, gold))]
    shared = [[c for p in predicted if (c := cross(g, p))] for g in gold]
    size = lambda g: (g[2] - g[0]) * (g[3] - g[1])
    return union_area(gold), union_area([c for s in shared for c in s]), len(gold), sum(1 for g, s in zip(gold, shared) if size(g) > 0 and union_area(s) / size(g) >= threshold)


def evidence_coverage(pages: DataFrame, gold: str, predicted: str) -> DataFrame:
    """pages with area coverage and region recall from their arrays of boxes."""

    @F.pandas_udf("gold_area double, covered_area double, boxes bigint, covered bigint")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in parts:
            yield pd.DataFrame([coverage_of_boxes([] if g is None else list(g), [] if p is None else list(p)) for g, p in zip(a, b)], columns=["gold_area", "covered_area", "boxes", "covered"])

    return pages.withColumn("coverage", run(gold, predicted))


def over_coverage(pages: DataFrame, by: Sequence[str], gold: str, predicted: str, rank: str, k: int) -> DataFrame:
    """(by, predicted_area, shared_area, precision): of the predicted boxes on the k best pages of each group, how much of their area lies in judged
    boxes. Boxes of one page count once where they lie over each other; pages without predictions have no area; without any the share is null."""

    @F.pandas_udf("predicted double, shared double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for gold_boxes, made in parts:
            rows = []
            for g, p in zip(gold_boxes, made):
                p = [] if p is None else [tuple(b) for b in p]
                area, shared, _, _ = coverage_of_boxes(p, [] if g is None else list(g))
                rows.append((area, shared))
            yield pd.DataFrame(rows, columns=["predicted", "shared"])

    each = pages.where(F.col(rank) <= k).select(*by, run(gold, predicted).alias("a"))
    out = each.groupBy(*by).agg(F.sum("a.predicted").alias("predicted_area"), F.sum("a.shared").alias("shared_area"))
    return out.withColumn("precision", F.col("shared_area") / F.nullif(F.col("predicted_area"), F.lit(0.0)))


def character_error_rate(reference: Column, text: Column) -> Column:
    """Edits between two texts over the reference's length; 0 for two empty ones, 1 where only the reference is empty."""
    n = F.length(reference)
    return F.when(n > 0, F.levenshtein(reference, text) / n).otherwise(F.when(F.length(text) > 0, 1.0).otherwise(0.0))


def edits(a: Sequence, b: Sequence) -> int:
    """Least number of insertions, deletions and replacements between two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_error_rate(reference: str, text: str) -> float:
    a, b = reference.split(), text.split()
    return edits(a, b) / len(a) if a else float(bool(b))


def indel_similarity(a: str, b: str) -> float:
    """1 less the insertions and deletions between two texts over their length together."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def near_match(needle: str, text: str, errors: int) -> bool:
    """Whether a part of a text differs from the needle by at most so many edits."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(needle, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row) <= errors


def anchored(text: str, anchor: str) -> bool:
    """Whether a literal stands in a text without a longer number at either end."""
    before = r"(?<![\d.,])" if anchor[:1].isdigit() else ""
    after = r"(?![\d]|[.,]\d)" if anchor[-1:].isdigit() else ""
    return re.search(before + re.escape(anchor) + after, text) is not None


def literal_citation(text: Column, start: Column, length: Column, excerpt: Column) -> Column:
    """Whether an excerpt is exactly the part of its passage that it says it is."""
    return (start >= 0) & (length >= 0) & (start + length <= F.length(text)) & (F.length(excerpt) == length) & (F.substr(text, (start + 1).cast("int"), length.cast("int")) == excerpt)


def hash_partition(df: DataFrame, id_col: str, category: str, seed: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """df's distinct ids with ``position`` and ``part``: in each category the ids in order of a hash, cut at the shares. Reproducible, and
    independent of order; parts of a category differ from their share by less than one row."""
    ids = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.coalesce(F.col(category), F.lit(""))).alias(category))
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col(category), F.col(id_col).cast("string")), 256)
    by = Window.partitionBy(category)
    placed = ids.withColumn("position", F.row_number().over(by.orderBy(key, id_col))).withColumn("_n", F.count(F.lit(1)).over(by))
    part, reach = None, 0.0
    for name, share in shares:
        reach += share
        hit = F.col("position") <= F.ceil(F.col("_n") * F.lit(min(1.0, round(reach, 9))))
        part = F.when(hit, name) if part is None else part.when(hit, name)
    return placed.withColumn("part", part).drop("_n")


def paired_bootstrap(pairs: DataFrame, cluster: str, a: str, b: str, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """One row: the mean difference b − a with its 95 % interval over resamples of clusters, and the numbers of gains and losses.

    Clusters are summed first; the resampling sees one row a cluster, spread over tasks by round."""
    sums = pairs.groupBy(cluster).agg(F.sum(F.col(b) - F.col(a)).alias("d"), F.count(F.lit(1)).alias("n")).orderBy(cluster)
    rows = [(r["d"], r["n"]) for r in sums.collect()]  # one row a cluster of a benchmark
    spark = pairs.sparkSession

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i in part["id"]:
                rng = random.Random(f"{seed}:{i}")
                pick = [rows[rng.randrange(len(rows))] for _ in rows]
                out.append(sum(d for d, _ in pick) / max(1, sum(n for _, n in pick)))
            yield pd.DataFrame({"mean": out})

    means = spark.range(rounds if rows else 0).mapInPandas(run, "mean double").agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    whole = pairs.agg(F.avg(F.col(b) - F.col(a)).alias("difference"), F.count_if(F.col(b) > F.col(a)).alias("gains"), F.count_if(F.col(b) < F.col(a)).alias("losses"), F.min(F.col(b) - F.col(a)).alias("worst"))
    return whole.join(means)  # one row each


def outcome_shares(checks: DataFrame, category: str, outcome: str, outcomes: Sequence[str]) -> DataFrame:
    """Share of each outcome by category, of the checks that could be run for ``passed``."""
    counts = checks.groupBy(category).agg(*[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes], F.count(F.lit(1)).alias("total"))
    return counts.withColumn("score", F.col(outcomes[0]) / F.nullif(F.col(outcomes[0]) + F.col(outcomes[1]), F.lit(0)))


def table_relations(cells: DataFrame, table: Sequence[str], row: str, col: str, text: str) -> DataFrame:
    """Each cell with its neighbours and the heading of its column. One window over rows and one over columns of a table."""
    across, down = Window.partitionBy(*table, row).orderBy(col), Window.partitionBy(*table, col).orderBy(row)
    return cells.select(*table, row, col, text, F.lag(text).over(across).alias("left"), F.lead(text).over(across).alias("right"), F.lag(text).over(down).alias("up"), F.lead(text).over(down).alias("down"), F.first(text).over(down).alias("heading"))


def check_text(kind: str, text: str, first: str, second: str = "", errors: int = 0) -> bool:
    """An extraction check: text present, absent, or two texts in order, allowing so many edits."""
    if kind == "present":
        return near_match(first, text, errors)
    if kind == "absent":
        return not near_match(first, text, errors)
    if kind == "order":
        a, b = text.find(first), text.find(second)
        return 0 <= a < b
    raise ValueError(kind)


def dcg(gains: Sequence[float]) -> float:
    return sum(g / math.log2(i + 2) for i, g in enumerate(gains))


def topic_metrics(ranked: DataFrame, query: str, label: str, wanted: str, total: DataFrame) -> DataFrame:
    """(query, top1, reciprocal_rank, recall6, ndcg10) of rankings whose rows are relevant when their label is the query's.

    ranked: (query, rank, label, wanted), total: (wanted, relevant)."""
    hit = F.col(label) == F.col(wanted)
    per = ranked.groupBy(query, wanted).agg(F.max(F.when((F.col("rank") == 1) & hit, 1).otherwise(0)).alias("top1"), F.min(F.when(hit, F.col("rank"))).alias("_first"), F.count_if(hit & (F.col("rank") <= 6)).alias("_six"), F.sum(F.when(hit & (F.col("rank") <= 10), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return per.join(total, wanted).select(query, "top1", F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("_six") / F.least(F.col("relevant"), F.lit(6))).alias("recall6"), (F.col("_dcg") / ideal).alias("ndcg10"))


