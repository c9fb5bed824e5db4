import random

import pytest
from pyspark.sql import functions as F

from strandex.llm import grouping, mixing, sampling


# Samples


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, batch int, w double, _p double")


def test_sample_ignores_order_and_repetition(spark):
    rows = [(i, i % 3, 1.0, None) for i in range(500)]
    a = sampling.consistent_sample(frame(spark, rows), "id", 0.2, batch_col="batch")
    shuffled = rows + rows[:200]
    random.Random(1).shuffle(shuffled)
    b = sampling.consistent_sample(frame(spark, shuffled).repartition(7), "id", 0.2, batch_col="batch")
    one = {(r["id"], r["selected_at"]) for r in a.collect()}
    assert one == {(r["id"], r["selected_at"]) for r in b.collect()}
    assert 60 < len(one) < 145


@pytest.mark.parametrize("weighted", [False, True])
def test_sample_keeps_what_was_selected(spark, weighted):
    rng = random.Random(2)
    rows = [(i, b, rng.choice([0.5, 1.0, 3.0]), None) for i in range(300) for b in range(4) if rng.random() < 0.4]
    before = set()
    for upto in range(4):
        got = sampling.consistent_sample(frame(spark, [r for r in rows if r[1] <= upto]), "id", 0.2, batch_col="batch", weight_col="w" if weighted else None)
        now = {r["id"] for r in got.collect()}
        assert before <= now
        before = now


@pytest.mark.parametrize("weighted", [False, True])
def test_state_keeps_what_was_selected(spark, weighted):
    """A later run with a lower share, with other weights and with the new batches only still has all earlier ids."""
    rng = random.Random(7)
    rows = [(i, b, rng.choice([0.5, 1.0, 3.0]), None) for i in range(300) for b in range(4) if rng.random() < 0.4]
    how = {"batch_col": "batch", "weight_col": "w" if weighted else None}
    first = sampling.inclusions(frame(spark, [r for r in rows if r[1] < 2]), "id", 0.3, **how)
    before = {r["id"]: r["selected_at"] for r in first.where("selected_at is not null").collect()}
    heavier = [(i, b, 100.0 if i > 250 else w, x) for i, b, w, x in rows if b >= 2]
    for later in (heavier, heavier[:3], []):
        got = {r["id"]: r["selected_at"] for r in sampling.consistent_sample(frame(spark, later), "id", 0.05, state=first, **how).collect()}
        assert all(got[i] == at for i, at in before.items())
    again = {r["id"] for r in sampling.consistent_sample(frame(spark, rows), "id", 0.3, state=first, **how).collect()}
    assert set(before) <= again and len(again) > len(before)
    assert sampling.inclusions(first.limit(0).select("id", F.lit(1).alias("batch"), F.lit(1.0).alias("w")), "id", 0.3, state=first, **how).count() == first.count()


def test_weighted_sample_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, b, rng.choice([0.5, 1.0, 3.0, None]), None) for i in range(120) for b in range(3) if rng.random() < 0.5]
    got = {r["id"]: (r["inclusion"], r["selected_at"]) for r in sampling.consistent_sample(frame(spark, rows), "id", 0.3, batch_col="batch", weight_col="w", seed="z").collect()}
    import hashlib

    top, prob, want = {}, {}, {}
    for b in range(3):
        for i, at, w, _ in rows:
            if at == b:
                top[i] = max(top.get(i, 0.0), w or 0.0)
        mean = sum(top.values()) / len(top)
        for i, w in top.items():
            prob[i] = max(prob.get(i, 0.0), min(1.0, 0.3 * w / mean))
            u = int(hashlib.md5(f"z|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            if u < prob[i] and i not in want:
                want[i] = b
    assert {i: b for i, (_, b) in got.items()} == want
    assert all(abs(got[i][0] - prob[i]) < 1e-9 for i in got)


def test_sample_nulls_and_empty(spark):
    rows = [(None, 1, 1.0, None), (1, None, None, None), (2, 2, -5.0, None)]
    assert {r["id"] for r in sampling.consistent_sample(frame(spark, rows), "id", 1.0, batch_col="batch").collect()} == {1, 2}
    assert sampling.consistent_sample(frame(spark, rows).limit(0), "id", 0.5, batch_col="batch", weight_col="w").count() == 0
    assert sampling.consistent_sample(frame(spark, rows), "id", spark.createDataFrame([(None,)], "s double")).count() == 0


# Groups


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {"random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], "chain": [(i, i + 1) for i in range(120)], "star": [(0, i) for i in range(1, 300)] + [(500, i) for i in range(290, 400)],
             "loops": [(1, 1), (2, 3), (3, 2), (None, 4), (5, None)]}[shape]
    got = {r["node"]: r["component"] for r in grouping.connected_components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()}
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_related_groups_and_authors(spark):
    records = spark.createDataFrame([(1, "Ann"), (2, " ann "), (3, "unknown"), (4, None), (5, "UNKNOWN"), (6, " "), (7, "Bob"), (None, "Bob"), (1, "Ann")], "id bigint, author string")
    docs = spark.createDataFrame([(7, "d"), (4, "d"), (99, "d"), (5, None)], "id bigint, doc string")
    links = spark.createDataFrame([(3, 12345), (6, 5), (None, 1)], "a bigint, b bigint")
    got = {r["id"]: r["group_id"] for r in grouping.related_groups(records, "id", [docs, records.select("id", grouping.author_key(F.col("author")).alias("k"))], [links]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 7: 4, 5: 5, 6: 5}


def test_components_of_nothing(spark):
    assert grouping.connected_components(spark.createDataFrame([], "x bigint, y bigint"), "x", "y").count() == 0


def test_splits(spark):
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.4), ("none", 0.0)], "target_name string, target_share double")
    rows = [(f"g{i // 3}",) for i in range(6000)] + [(None,)]
    got = grouping.assign_splits(spark.createDataFrame(rows, "g string"), "g", targets)
    shares = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert got.where("g is not null").groupBy("g").agg(F.count_distinct("split").alias("n")).where("n <> 1").count() == 0
    assert shares[None] == 1 and abs(shares["train"] / 6000 - 0.8) < 0.03 and abs(shares["test"] / 6000 - 0.1) < 0.03
    assert {r["split"] for r in grouping.assign_splits(spark.createDataFrame(rows[:5], "g string"), "g", targets.limit(0)).collect()} == {None}
    # groups keep their splits when one of them grows to a third of all rows and others are added
    more = grouping.assign_splits(spark.createDataFrame(rows + [("g7",)] * 4000 + [(f"h{i}",) for i in range(2000)], "g string"), "g", targets)
    before = {r["g"]: r["split"] for r in got.distinct().collect()}
    after = {r["g"]: r["split"] for r in more.distinct().collect()}
    assert all(after[g] == s for g, s in before.items())


# Mixtures


def test_mixture_meets_shares_and_caps(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice("aaaaabbc"), rng.randrange(1, 400)) for i in range(3000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 5), ("nowhere", 0.3, 2), ("zero", 0.0, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs + docs[:100] + [(None, "a", 5), (99999, None, 5), (99998, "b", 0), (99997, "b", None)], "doc_id bigint, source string, n_tokens bigint")
    got = mixing.mixture(df, targets).collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    cap = {"a": 1, "b": 4, "c": 5}
    assert all(1 <= r["copies"] <= cap[r["source"]] for r in got)
    total = sum(r["copies"] * r["n_tokens"] for r in got)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(r["copies"] * r["n_tokens"] for r in got if r["source"] == s) / total - share) < 0.01
    again = mixing.mixture(df.repartition(5), targets).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in again}
    shares = {r["source"]: r for r in mixing.reached_shares(mixing.mixture(df, targets), targets).collect()}
    assert shares["nowhere"]["tokens"] == 0 and abs(shares["a"]["share"] - 0.5) < 0.01


def test_mixture_takes_the_least_ranks(spark):
    """Against a plain Pareto order sample: within a source the drawn documents are those of the least rank."""
    docs = [(i, "a", 100) for i in range(400)] + [(1000 + i, "b", 100) for i in range(100)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    got = {r["doc_id"] for r in mixing.mixture(df, targets).collect()}
    from strandex.llm.common import unit_hash

    u = {r["doc_id"]: r["u"] for r in df.select("doc_id", unit_hash(F.col("doc_id"), seed=8).alias("u")).collect()}
    ranked = sorted((i for i, s, _ in docs if s == "a"), key=lambda i: u[i] / (1 - u[i]))
    assert {i for i in got if i < 1000} == set(ranked[:100]) and len(got) == 200


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mixing.mixture(spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint"), targets).count() == 0
