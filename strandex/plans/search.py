"""Keyword, vector and hybrid search over the test tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_tokens
from ..operators import clauses as C
from ..operators import postings as Index
from ..operators import ranking as R
from ..operators import vectors as V
from ..store import Store, head_column
from .common import Registry, shared_folder, table

R_ = Registry()

TOKENS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def canon(c: str) -> str:
    return f"coalesce(array_to_string({TOKENS.format(c=c)}, ' '), '')"


def passages(spark: SparkSession, d: str, *cols: str, where: str | None = None) -> DataFrame:
    """The latest row of each passage, with the columns asked for. Rows are filtered and narrowed before they are shuffled by id."""
    rows = table(spark, d, "passages")
    rows = rows if where is None else rows.where(where)
    wanted = [c for c in (cols or rows.columns) if c not in ("id", "ingested_at")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*wanted), "ingested_at").alias("_r")).select("id", "_r.*")


def with_canonical(df: DataFrame, **cols: str) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.array_join(ascii_tokens(F.col(c)), " "), F.lit("")) for k, c in cols.items()})


P = "p AS (SELECT DISTINCT ON (id) id, document_id, content_id, ordinal, section_id, section_offset, display_text, body_text, title, heading, file_name, source_path, content_name, email_subject FROM passages)"

_BM25_ONE = f"""WITH d AS (SELECT doc_id, {canon('text')} AS c FROM documents),
t AS (SELECT doc_id, c, CASE WHEN length(c) > 0 THEN len(string_split(c, ' ')) ELSE 0 END AS dl, len(list_filter(string_split(c, ' '), lambda x: x = 'depot')) AS c0, len(list_filter(string_split(c, ' '), lambda x: x = 'pallets')) AS c1 FROM d),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS a, CAST(count(*) FILTER (c0 > 0) AS DOUBLE) AS d0, CAST(count(*) FILTER (c1 > 0) AS DOUBLE) AS d1 FROM t),
z AS (SELECT doc_id, (CASE WHEN ln((n - d0 + 0.5) / (d0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d0 + 0.5) / (d0 + 0.5)) END) * c0 * 2.2 / (c0 + 1.2 * (0.25 + 0.75 * dl / a)) +
(CASE WHEN ln((n - d1 + 0.5) / (d1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d1 + 0.5) / (d1 + 0.5)) END) * c1 * 2.2 / (c1 + 1.2 * (0.25 + 0.75 * dl / a)) AS score FROM t, s WHERE c0 > 0 OR c1 > 0)
SELECT doc_id, round(score, 6) AS score FROM z ORDER BY round(score, 6) DESC, doc_id LIMIT 20"""


@R_.add(_BM25_ONE)
def keyword_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Twenty best documents for two words in one field."""
    docs = with_canonical(table(spark, d, "documents").select("doc_id", "text"), body="text").drop("text")
    words = [C.Clause("a", "depot", "should", fields=("body",)), C.Clause("b", "pallets", "should", fields=("body",))]
    return R.top(R.bm25(docs, "doc_id", {"body": "body"}, words, {"body": 1.0}), "score", "doc_id", 20, 6).select("doc_id", F.round("score", 6).alias("score"))


_FIELDS = {"body": ("body_text", 1.0), "title": ("title", 3.0), "heading": ("heading", 2.0), "filename": ("file_name", 2.5)}


def _fields_sql() -> str:
    cols = ", ".join(f"{canon(c)} AS k_{f}" for f, (c, _) in _FIELDS.items())
    dl = " + ".join(f"CASE WHEN length(k_{f}) > 0 THEN len(string_split(k_{f}, ' ')) ELSE 0 END" for f in _FIELDS)
    terms = ("archive", "plan")
    counts, dfs, score = [], [], []
    for i, t in enumerate(terms):
        for f, (_, w) in _FIELDS.items():
            n = f"{f}{i}"
            counts.append(f"len(list_filter(string_split(k_{f}, ' '), lambda x: x = '{t}')) AS c_{n}")
            dfs.append(f"CAST(count(*) FILTER (c_{n} > 0) AS DOUBLE) AS d_{n}")
            score.append(f"(CASE WHEN ln((n - d_{n} + 0.5) / (d_{n} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d_{n} + 0.5) / (d_{n} + 0.5)) END) * {w} * c_{n} * 2.2 / ({w} * c_{n} + 1.2 * (0.25 + 0.75 * dl / a))")
    return (f"WITH {P}, k AS (SELECT id, {cols} FROM p), t AS (SELECT id, CAST({dl} AS DOUBLE) AS dl, {', '.join(counts)} FROM k), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS a, {', '.join(dfs)} FROM t), "
            f"z AS (SELECT id, round({' + '.join(score)}, 6) AS score FROM t, s) SELECT id, score FROM z WHERE score > 0 ORDER BY score DESC, id LIMIT 50")


@R_.add(_fields_sql())
def keyword_bm25_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fifty best passages for two words over four weighted fields, each clause and field a phrase of its own."""
    rows = with_canonical(passages(spark, d, *[c for c, _ in _FIELDS.values()]), **{f"k_{f}": c for f, (c, _) in _FIELDS.items()})
    words = [C.Clause("a", "archive", "should", fields=tuple(_FIELDS)), C.Clause("b", "plan", "should", fields=tuple(_FIELDS))]
    got = R.bm25(rows.select("id", *[f"k_{f}" for f in _FIELDS]), "id", {f: f"k_{f}" for f in _FIELDS}, words, {f: w for f, (_, w) in _FIELDS.items()})
    return R.top(got.withColumn("score", F.round("score", 6)), "score", "id", 50).select("id", "score")


_POSTINGS = f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format(c='text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term HAVING count(DISTINCT doc_id) > 1"""


@R_.add(_POSTINGS)
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document and corpus frequency of each term of the inverted index that more than one document has."""
    docs = table(spark, d, "documents").select("doc_id", ascii_tokens(F.col("text")).alias("tokens"))
    postings, _ = R.build_postings(docs, "doc_id", {"body": "tokens"}, positions=False)
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where("df > 1")


_BATCH = f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format(c='text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS c FROM t GROUP BY ALL),
l AS (SELECT doc_id, coalesce(len({TOKENS.format(c='text')}), 0) AS dl FROM documents), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS a FROM l), df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT query_id, unnest({TOKENS.format(c='text')}) AS term FROM eval_queries WHERE query_id % 50 = 0),
z AS (SELECT query_id, doc_id, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / a))) AS score
FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (doc_id), s GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM z) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10"""


@R_.add(_BATCH)
def keyword_batch(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents for each of a stated set of queries (ids divisible by 50), all at once against all documents."""
    docs = table(spark, d, "documents").select("doc_id", ascii_tokens(F.col("text")).alias("tokens"))
    terms = table(spark, d, "eval_queries").where("query_id % 50 = 0").select("query_id", F.explode(ascii_tokens(F.col("text"))).alias("term"))
    return R.bm25_many(docs, "doc_id", "tokens", terms, 10, 5).select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


@R_.add(_BATCH)
def keyword_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stored index: it is written once, then only the folders of the queries' terms are read."""
    store = Store(spark, f"{shared_folder(spark)}/keyword-index-{uuid4().hex[:8]}")
    docs = with_canonical(table(spark, d, "documents").select("doc_id", "text"), body="text").drop("text")
    postings, lengths = Index.index_rows(docs.withColumn("document_id", F.col("doc_id").cast("string")), "document", "doc_id", {"body": "body"}, ["document_id"])
    store.commit({"postings": postings, "lengths": lengths}, lengths)
    terms = table(spark, d, "eval_queries").where("query_id % 50 = 0").select("query_id", F.explode(ascii_tokens(F.col("text"))).alias("term")).distinct()
    heads = [r["h"] for r in terms.select(head_column(F.col("term")).alias("h")).distinct().collect()]  # HEADS at most
    at = store.manifest()
    held = store.postings_of(heads, at).select("id", "term", F.size("positions").alias("tf"))
    return R.bm25_postings(held, store.read("lengths", at).select("id", "length"), terms, 10, 5).select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


CLAUSES = [
    C.Clause("m", "depot", "must", "prefix", ("body",)),
    C.Clause("s1", "with the label", "should", "phrase", ("body",)),
    C.Clause("s2", "archive", "should", "term", ("title", "heading")),
    C.Clause("s3", "boxes", "should", "term", ("body",)),
    C.Clause("n", "passwords", "must_not", "term", ("body", "title")),
]
_CLAUSE_SQL = f"""WITH {P}, k AS (SELECT id, ' ' || {canon('body_text')} || ' ' AS b, ' ' || {canon('title')} || ' ' AS t, ' ' || {canon('heading')} || ' ' AS h FROM p),
e AS (SELECT id, contains(b, ' depot') AS m, contains(b, ' with the label ') AS s1, contains(t, ' archive ') OR contains(h, ' archive ') AS s2, contains(b, ' boxes ') AS s3, contains(b, ' passwords ') OR contains(t, ' passwords ') AS n FROM k)
SELECT id, CAST(s1::INT + s2::INT + s3::INT AS BIGINT) AS should_matched, array_to_string(list_filter([CASE WHEN m THEN 'm' END, CASE WHEN s1 THEN 's1' END, CASE WHEN s2 THEN 's2' END, CASE WHEN s3 THEN 's3' END], lambda x: x IS NOT NULL), ',') AS matched
FROM e WHERE m AND NOT n"""


def _evaluated(spark: SparkSession, d: str):
    rows = with_canonical(passages(spark, d, "document_id", "content_id", "body_text", "title", "heading"), k_body="body_text", k_title="title", k_heading="heading")
    fields = {"body": F.col("k_body"), "title": F.col("k_title"), "heading": F.col("k_heading")}
    return rows, fields


def _clauses(spark: SparkSession, d: str, msm: int) -> DataFrame:
    rows, fields = _evaluated(spark, d)
    e = C.evaluate(CLAUSES, fields, msm)
    return rows.where(e.matches).select("id", e.should_matched.cast("bigint").alias("should_matched"), F.array_join(C.matched_ids(CLAUSES, e.hits), ",").alias("matched"))


@R_.add(_CLAUSE_SQL)
def clause_filter(spark: SparkSession, d: str) -> DataFrame:
    """Prefix, phrase, term and exclusion over several fields, with the clauses that matched."""
    return _clauses(spark, d, 0)


@R_.add(_CLAUSE_SQL.replace("WHERE m AND NOT n", "WHERE m AND NOT n AND s1::INT + s2::INT + s3::INT >= 2"))
def clause_minimum_should_match(spark: SparkSession, d: str) -> DataFrame:
    """The same with at least two should clauses."""
    return _clauses(spark, d, 2)


@R_.add(_CLAUSE_SQL.replace("WHERE m AND NOT n", "WHERE m AND NOT n AND (s1 OR s2 OR s3)"))
def clause_optional_boost(spark: SparkSession, d: str) -> DataFrame:
    """The branch that boosts: every must and at least one of the optional clauses."""
    rows, fields = _evaluated(spark, d)
    e = C.evaluate(CLAUSES, fields, 0)
    return rows.where(C.optional_boost(CLAUSES, 0, fields)).select("id", e.should_matched.cast("bigint").alias("should_matched"), F.array_join(C.matched_ids(CLAUSES, e.hits), ",").alias("matched"))


_RERANK = f"""WITH {P}, k AS (SELECT id, ' ' || {canon('body_text')} || ' ' AS b, ' ' || {canon('heading')} || ' ' AS h FROM p),
e AS (SELECT id, contains(b, ' depot ') AS m, contains(b, ' label ')::INT + contains(h, ' archive ')::INT AS s, length(b) AS len FROM k),
mn AS (SELECT id, s, row_number() OVER (ORDER BY len DESC, id) AS r FROM e WHERE m QUALIFY r <= 1000), ob AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, len DESC, id) AS r FROM e WHERE m AND s > 0 QUALIFY r <= 1000),
mm AS (SELECT count(*) AS n FROM mn),
z AS (SELECT id, coalesce(mn.s, ob.s) AS s, coalesce(mn.r, n + ob.r) AS base, 1.0 / (60 + coalesce(mn.r, n + ob.r)) + coalesce(CASE WHEN coalesce(mn.s, ob.s) > 0 THEN 0.6 * (coalesce(mn.s, ob.s) / 2.0) / (60 + ob.r) END, 0) AS score FROM mn FULL JOIN ob USING (id), mm)
SELECT id, round(score, 9) AS keyword_score, row_number() OVER (ORDER BY round(score, 12) DESC, base, id) AS keyword_rank FROM z"""


@R_.add(_RERANK)
def keyword_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Main and optional candidates, at most a thousand each, in one order."""
    rows, fields = _evaluated(spark, d)
    q = [C.Clause("m", "depot", "must", fields=("body",)), C.Clause("a", "label", "should", fields=("body",)), C.Clause("b", "archive", "should", fields=("heading",))]
    e = C.evaluate(q, fields, 0)
    size = F.length("k_body") + F.when(F.length("k_body") >= 0, 2)
    found = rows.where(e.matches).select("id", e.should_matched.alias("should_matched"), size.alias("len")).withColumn("matches", F.lit(True))
    by_length, by_matches = [F.col("len").desc(), F.col("id")], [F.col("should_matched").desc(), F.col("len").desc(), F.col("id")]
    main = R.ranked(found.orderBy(*by_length).limit(1000).persist(), by_length, "rank").drop("len")
    optional = R.ranked(found.where("should_matched > 0").orderBy(*by_matches).limit(1000), by_matches, "rank").drop("len")
    return R.keyword_rerank(main, optional, "id", 2, 3, 0).select("id", F.round("keyword_score", 9).alias("keyword_score"), F.col("keyword_rank").cast("bigint").alias("keyword_rank"))


# Vectors

_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


@R_.add(f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings e, {_Q0} q WHERE e.label <> 3 ORDER BY score DESC, vec_id LIMIT 25")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The 25 nearest vectors to one, filtered before ranking."""
    e = table(spark, d, "embeddings")
    query = e.where("vec_id = 0").select("embedding").first()[0]
    return V.vector_top_k(e, query, 25, "vec_id", "embedding", F.col("label") != 3)


_MANY = f"""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, e.vec_id, round({_DOT}, 6) AS score FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10"""


def _many(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.vector_top_k_many(e, e.where("vec_id % 50 = 0").select("vec_id", "embedding"), k, "vec_id", "embedding").select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@R_.add(_MANY)
def vector_top_k_many(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every query (ids divisible by 50) against all, in blocks of queries."""
    return _many(spark, d, 10)


@R_.add("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@R_.add("""WITH l AS (SELECT label, list_transform(range(1, 65), lambda i: 0) AS z FROM embeddings LIMIT 0), c AS (SELECT label, count(*) AS total, count(embedding) AS with_vector, count(*) FILTER (len(embedding) = 64) AS compatible FROM embeddings GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, total, with_vector, compatible, CASE WHEN compatible = 0 THEN 'none' WHEN compatible = total THEN 'complete' ELSE 'partial' END AS status FROM c""")
def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    got = V.coverage(e.select("vec_id", "label"), e.select(F.col("vec_id").alias("v"), "embedding"), "vec_id", "v", "embedding", 64, ["label"])
    return got.select(F.col("label").cast("bigint").alias("label"), "total", "with_vector", "compatible", "status")


@R_.add("SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS vectors FROM (SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY embedding HAVING count(*) > 1)")
def identical_vectors(spark: SparkSession, d: str) -> DataFrame:
    got = V.identical_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return got.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("vectors"))


# Fusion

_FUSE = f"""WITH {P}, k AS (SELECT id, document_id, content_id, {canon('body_text')} AS b, {canon('heading')} AS h FROM p),
a AS (SELECT id, row_number() OVER (ORDER BY length(b) DESC, id) AS r FROM k WHERE contains(' ' || b || ' ', ' archive ')), c AS (SELECT id, row_number() OVER (ORDER BY length(h) DESC, id) AS r FROM k WHERE length(h) > 0),
ka AS (SELECT * FROM a WHERE r <= 200), kc AS (SELECT * FROM c WHERE r <= 200),
f AS (SELECT id, coalesce(0.75 / (60 + ka.r), 0) + coalesce(0.25 / (60 + kc.r), 0) AS score, least(coalesce(ka.r, 99999), coalesce(kc.r, 99999)) AS best_rank, ka.r AS keyword_rank, kc.r AS semantic_rank FROM ka FULL JOIN kc USING (id))"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _evaluated(spark, d)
    a = R.ranked(rows.where(C.field_hit(C.Clause("a", "archive"), F.col("k_body"))), [F.length("k_body").desc(), F.col("id")], "rank").where("rank <= 200").select("id", "rank")
    b = R.ranked(rows.where(F.length("k_heading") > 0), [F.length("k_heading").desc(), F.col("id")], "rank").where("rank <= 200").select("id", "rank")
    return R.reciprocal_rank_fusion({"keyword": a, "semantic": b}, "id", {"keyword": 3.0, "semantic": 1.0})


@R_.add(_FUSE + " SELECT id, round(score, 9) AS score, CAST(best_rank AS BIGINT) AS best_rank, keyword_rank, semantic_rank FROM f")
def fusion(spark: SparkSession, d: str) -> DataFrame:
    """Weighted reciprocal ranks of two branches."""
    return _fused(spark, d).select("id", F.round("score", 9).alias("score"), *[F.col(c).cast("bigint").alias(c) for c in ("best_rank", "keyword_rank", "semantic_rank")])


_GROUPS = _FUSE + """, g AS (SELECT document_id, content_id, max(round(score, 9)) AS score, arg_max(id, (round(score, 9), -n)) AS best, count(*) AS hits FROM (SELECT f.*, document_id, content_id, row_number() OVER (PARTITION BY content_id ORDER BY round(score, 9) DESC, id) AS n FROM f JOIN k USING (id)) GROUP BY document_id, content_id),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, content_id) AS dn FROM g), r AS (SELECT * FROM n WHERE dn <= 3 ORDER BY score DESC, document_id, content_id LIMIT 20)"""


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hits = _fused(spark, d).withColumn("score", F.round("score", 9)).join(passages(spark, d, "document_id", "content_id"), "id")
    groups = R.group_hits(hits, ["document_id", "content_id"], "score", "id")
    return groups, R.limit_per_document(groups, "document_id", [F.col("score").desc(), F.col("document_id"), F.col("content_id")], 3, 20)


@R_.add(_GROUPS + " SELECT document_id, content_id, score, best, hits FROM r")
def fusion_groups(spark: SparkSession, d: str) -> DataFrame:
    """Hits grouped by content, at most three groups of a document, the best twenty."""
    return _groups(spark, d)[1]


@R_.add(_GROUPS + " SELECT g.document_id, count(*) AS matched, count(r.content_id) AS returned, count(*) - count(r.content_id) AS suppressed FROM g LEFT JOIN r USING (content_id) GROUP BY g.document_id HAVING count(*) > count(r.content_id)")
def fusion_suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Documents with groups that the limits left out."""
    groups, returned = _groups(spark, d)
    return R.suppressed_sources(groups, returned, "document_id", "content_id").select("document_id", "matched", F.col("returned").cast("bigint").alias("returned"), F.col("suppressed").cast("bigint").alias("suppressed"))


@R_.add()
def section_corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Bonus of sections with several good passages for a query, by vectors of hashed tokens."""
    embed = V.hashing_embedder()
    rows = passages(spark, d, "section_id", "section_offset", "body_text", "heading", "display_text", where="section_id IS NOT NULL")
    query = spark.range(1).select(embed(F.lit("the depot returned pallets with the label")).alias("q")).first()[0]
    scored = rows.withColumn("v", embed("body_text")).withColumn("score", V.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in query])))
    return R.corroboration(scored.withColumn("only", F.coalesce(F.trim("display_text") == F.trim("heading"), F.lit(False))), "section_id", "score", "section_offset", "id", "only")


