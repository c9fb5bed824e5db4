"""Sections, chunks, layout, metrics and text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clauses as C
from ..operators import geometry as G
from ..operators import metrics as M
from ..operators import previews as V
from ..operators import sections as S
from .common import Registry, table
from .search import _fused, _many, passages

R = Registry()
PASS = "p AS (SELECT DISTINCT ON (id) * EXCLUDE (ingested_at) FROM passages)"
BLOCKS = "b AS (SELECT DISTINCT block_id, document_id, page_number, ordinal, text, font_size, extraction_method, confidence, is_table, warning, bold_fraction, page_region FROM pdf_blocks)"
LINES = "l AS (SELECT DISTINCT line_id, document_id, page_number, line_no, text, confidence, page_region FROM ocr_lines)"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_blocks").drop("ingested_at").dropDuplicates(["block_id"])


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_lines").drop("ingested_at").dropDuplicates(["line_id"])


# Sections


@R.add(f"""WITH {BLOCKS}, s AS (SELECT *, 'page:' || page_number AS boundary FROM b), c AS (SELECT *, CASE WHEN lag(boundary) OVER w IS DISTINCT FROM boundary THEN 1 ELSE 0 END AS n FROM s WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, block_id)),
o AS (SELECT *, sum(n) OVER (PARTITION BY document_id, boundary ORDER BY ordinal, block_id) - 1 AS occ FROM c), k AS (SELECT *, CASE WHEN n = 1 THEN boundary || ':occurrence:' || occ END AS made FROM o)
SELECT block_id, last_value(made IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal, block_id) AS section_key FROM k""")
def section_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of sections where blocks of pages alternate: a page that comes again is another occurrence."""
    b = blocks(spark, d).select("block_id", "document_id", F.struct("ordinal", "block_id").alias("o"), F.concat(F.lit("page:"), F.col("page_number").cast("string")).alias("boundary"))
    return S.assign_keys(b, "document_id", "o", "boundary").select("block_id", "section_key")


_MEMBERS = f"""WITH {PASS}, m AS (SELECT content_id, ordinal, id, coalesce(display_text, '') AS t FROM p)"""


@R.add(_MEMBERS + " SELECT content_id, string_agg(t, chr(10) ORDER BY ordinal, id) FILTER (length(t) > 0) AS text, count(*) AS members FROM m GROUP BY 1")
def built_sections(spark: SparkSession, d: str) -> DataFrame:
    return S.build_sections(passages(spark, d).select("content_id", "ordinal", "id", "display_text"), "content_id", ["ordinal", "id"], "display_text")


@R.add(_MEMBERS + """ SELECT id, CAST(coalesce(sum(length(t)) OVER w, 0) + CASE WHEN length(t) > 0 THEN coalesce(count(*) FILTER (length(t) > 0) OVER w, 0) ELSE greatest(0, coalesce(count(*) FILTER (length(t) > 0) OVER w, 0) - 1) END AS BIGINT) AS "offset"
FROM m WINDOW w AS (PARTITION BY content_id ORDER BY ordinal, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def member_offsets(spark: SparkSession, d: str) -> DataFrame:
    got = S.member_offsets(passages(spark, d).select("content_id", "ordinal", "id", "display_text"), "content_id", ["ordinal", "id"], "display_text")
    return got.select("id", F.col("offset").cast("bigint").alias("offset"))


@R.add(f"WITH {PASS} SELECT id FROM p WHERE NOT coalesce(extraction_method = 'Ocr' AND ocr_confidence < 40, false) AND (contains(display_text, chr(9)) OR regexp_matches(display_text, '(?s)\\p{{L}}.*\\p{{L}}'))")
def semantic_substance(spark: SparkSession, d: str) -> DataFrame:
    p = passages(spark, d)
    return p.where(S.has_substance(F.col("display_text"), F.contains("display_text", F.lit("\t")), F.col("extraction_method"), F.col("ocr_confidence"))).select("id")


@R.add()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every section cut into chunks that end at sentences."""
    s = table(spark, d, "sections").select("id", "display_text").distinct()
    return s.select("id", F.posexplode(S.chunks_column(F.col("display_text"), F.contains(F.coalesce("display_text", F.lit("")), F.lit("\t")))).alias("chunk_no", "c")).select("id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "c.start", "c.text")


# Layout


@R.add(f"""WITH {BLOCKS}, k AS (SELECT *, CASE WHEN (page_region.y < 0.09 OR page_region.y + page_region.height > 0.91) AND length(text) < 240 THEN nullif(regexp_replace(upper(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '\\d+', '#', 'g'), '') END AS key FROM b),
n AS (SELECT document_id, count(DISTINCT page_number) AS pages FROM b GROUP BY 1), r AS (SELECT document_id, key FROM k JOIN n USING (document_id) WHERE key IS NOT NULL AND pages >= 3 GROUP BY document_id, key, pages HAVING count(DISTINCT page_number) >= greatest(3, ceil(pages * 0.6)))
SELECT block_id, r.key IS NOT NULL AS boilerplate FROM k LEFT JOIN r ON r.document_id = k.document_id AND r.key = k.key""")
def repeated_margins(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return G.repeated_margins(b, "document_id", "page_number", "text", F.col("page_region.y"), F.col("page_region.height")).select("block_id", "boilerplate")


_SIZES = f"""WITH {BLOCKS}, u AS (SELECT * FROM b WHERE extraction_method = 'NativeText' AND NOT is_table AND font_size > 0), s AS (SELECT document_id, font_size, sum(greatest(1, length(text))) AS w FROM u GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY document_id ORDER BY font_size) AS cum, floor(sum(w) OVER (PARTITION BY document_id) / 2) AS half FROM s), t AS (SELECT document_id, min(font_size) AS typical_size FROM c WHERE cum > half GROUP BY 1)"""


@R.add(_SIZES + " SELECT document_id, typical_size FROM t")
def typical_font_size(spark: SparkSession, d: str) -> DataFrame:
    use = blocks(spark, d).where("extraction_method = 'NativeText' AND NOT is_table AND font_size > 0")
    return G.weighted_median(use, ["document_id"], "font_size", F.greatest(F.lit(1), F.length("text")), "typical_size")


@R.add(_SIZES + """ SELECT document_id, typical_size, heading_size, dense_rank() OVER (PARTITION BY document_id ORDER BY heading_size DESC) AS level FROM (SELECT DISTINCT u.document_id, typical_size, round(font_size * 2) / 2 AS heading_size FROM u JOIN t USING (document_id)
WHERE length(text) <= 180 AND length(text) - length(replace(text, chr(10), '')) <= 2 AND len(regexp_split_to_array(trim(text), '\\s+')) <= 18 AND font_size >= typical_size * 1.2)""")
def heading_sizes(spark: SparkSession, d: str) -> DataFrame:
    got = G.heading_candidates(blocks(spark, d), "document_id", "text", "font_size", "is_table", F.col("extraction_method") == "NativeText")
    return got.select("document_id", "typical_size", "heading_size", F.col("level").cast("bigint").alias("level"))


@R.add(f"""WITH {BLOCKS}, x AS (SELECT block_id, document_id, page_number, page_region.x AS x, page_region.y AS y, page_region.width AS w, page_region.height AS h FROM b), j AS (SELECT a.document_id, a.page_number, a.block_id AS a, c.block_id AS b, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x) AS iw,
least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y) AS ih, least(a.w * a.h, c.w * c.h) AS least_area FROM x a JOIN x c ON a.document_id = c.document_id AND a.page_number = c.page_number AND a.block_id < c.block_id)
SELECT document_id, CAST(page_number AS BIGINT) AS page_number, a, b, round(iw * ih, 9) AS area FROM j WHERE iw > 0 AND ih > 0 AND iw * ih > 0.001 * least_area""")
def overlapping_blocks(spark: SparkSession, d: str) -> DataFrame:
    got = G.overlapping(blocks(spark, d), ["document_id", "page_number"], "block_id", "page_region", 0.001)
    return got.select("document_id", F.col("page_number").cast("bigint").alias("page_number"), "a", "b", F.round("area", 9).alias("area"))


@R.add()
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    got = G.order_pages(lines(spark, d), ["document_id", "page_number"], "line_id", "text", "page_region")
    return got.select("document_id", "page_number", "line_id", "position")


@R.add()
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("block_id", F.round(G.quality_column(F.col("text")), 6).alias("quality"))


# Text functions


@R.add(f"WITH {PASS} SELECT id, list_aggregate(regexp_extract_all(lower(heading), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), 'string_agg', ' ') AS canonical FROM p WHERE heading IS NOT NULL")
def canonical_headings(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).where("heading IS NOT NULL").select("id", F.nullif(F.array_join(X.ascii_tokens(F.col("heading")), " "), F.lit("")).alias("canonical"))


@R.add(f"WITH {PASS} SELECT id, upper(regexp_replace(file_name, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS evidence_key, CASE WHEN upper(trim(title)) = upper(file_name) OR upper(trim(title)) = upper(regexp_replace(file_name, '\\.[^.]*$', '')) OR title IS NULL THEN '' ELSE title END AS title FROM p")
def names_and_titles(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).select("id", X.evidence_key(F.col("file_name")).alias("evidence_key"), X.independent_title(F.col("title"), F.col("file_name")).alias("title"))


@R.add("SELECT doc_id, regexp_replace(regexp_extract(text, '(?mi)^Subject:[ \\t]*(\\S.*)$', 1), '\\s+$', '') AS subject FROM documents WHERE regexp_matches(text, '(?mi)^Subject:[ \\t]*\\S')")
def email_subjects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.email_subject(F.col("text")).alias("subject")).where("subject IS NOT NULL")


@R.add()
def character_error_rate(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("document_id", "page_number").orderBy("line_no", "line_id")
    x = lines(spark, d).select("line_id", "text", F.lead("text").over(w).alias("nxt")).where("nxt IS NOT NULL AND length(text) > 0")
    return x.select("line_id", F.round(M.character_error_rate(F.col("text"), F.col("nxt")), 6).alias("cer"))


@R.add("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


@R.add()
def display_forms(spark: SparkSession, d: str) -> DataFrame:
    """Display, search and canonical forms of passages."""
    p = passages(spark, d)
    return p.select("id", X.display_column(F.col("display_text")).alias("shown"), X.search_column(F.col("display_text")).alias("searched"), X.canonical_column(F.col("display_text")).alias("canonical"))


# Previews


@R.add()
def previews(spark: SparkSession, d: str) -> DataFrame:
    """Previews of the best groups of a fused search: literal parts of their passages."""
    q = [C.Clause("a", "archive", "should", fields=("body", "heading")), C.Clause("b", "the label", "should", "phrase", ("body",))]
    hits = _fused(spark, d).orderBy(F.col("score").desc(), "id").limit(200)
    cols = passages(spark, d).select("id", "content_id", "ordinal", F.col("display_text").alias("text"), "section_id", F.col("section_offset").alias("offset"), "heading", F.col("source_location.page").alias("page"))
    rows = hits.select("id", "score").join(cols, "id").withColumnsRenamed({"section_id": "section"}).withColumn("content", F.col("content_id"))
    return V.previews(rows, "content_id", q, 2, "Which archive has the label?")


@R.add()
def preview_citations(spark: SparkSession, d: str) -> DataFrame:
    """How many previews are literally what stands at their place."""
    shown = previews(spark, d)
    j = shown.join(passages(spark, d).select("id", "display_text"), "id")
    return j.agg(F.count(F.lit(1)).alias("previews"), F.count_if(M.literal_citation(F.col("display_text"), F.col("start"), F.col("length"), F.col("excerpt"))).alias("literal"))


# Metrics

_QRELS = "q AS (SELECT DISTINCT query_id, unnest(qrels) AS j FROM eval_queries), g AS (SELECT query_id, j.corpus_id AS item, CAST(max(j.score) AS DOUBLE) AS gain FROM q WHERE j.score > 0 AND j.corpus_id IS NOT NULL GROUP BY ALL)"
_RANKED = "k AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || '|' || item), item) AS rank FROM (SELECT DISTINCT query_id, j.corpus_id AS item FROM q WHERE j.corpus_id IS NOT NULL UNION SELECT query_id, (query_id * 7) % 900 FROM q UNION SELECT query_id, (query_id * 13) % 900 FROM q))"


@R.add(f"""WITH {_QRELS}, {_RANKED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, item) AS r FROM g), i AS (SELECT query_id, count(*) AS relevant, sum(gain / log2(r + 1)) FILTER (r <= 3) AS ideal FROM b GROUP BY 1),
f AS (SELECT g.query_id, count(*) AS n, min(rank) AS first, sum(gain / log2(rank + 1)) AS dcg FROM k JOIN g USING (query_id, item) WHERE rank <= 3 GROUP BY 1)
SELECT query_id, round(coalesce(n / relevant, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg / ideal, 0), 6) AS ndcg, relevant FROM i LEFT JOIN f USING (query_id)""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and graded gain at 3 of a ranking by hash of judged and other pages."""
    q = table(spark, d, "eval_queries").select("query_id", F.explode("qrels").alias("j"))
    judged = q.select("query_id", F.col("j.corpus_id").cast("bigint").alias("item"), F.col("j.score").alias("gain")).where("item IS NOT NULL")
    other = lambda n: q.select("query_id", (F.col("query_id") * n % 900).alias("item"))
    pool = judged.select("query_id", "item").unionByName(other(7)).unionByName(other(13)).distinct()
    key = F.md5(F.concat_ws("|", F.col("query_id").cast("string"), F.col("item").cast("string")).cast("binary"))
    ranked = M.rank_pages(pool, "query_id", ["item"], [key, F.col("item")])
    got = M.ranking_metrics(ranked, judged, "query_id", "item", 3)
    return got.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")], "relevant")


@R.add("""WITH q AS (SELECT vec_id AS query_id, label AS wanted, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, wanted, e.vec_id, e.label, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS score FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), n AS (SELECT label AS wanted, count(*) AS relevant FROM embeddings GROUP BY 1)
SELECT query_id, CAST(max((rank = 1 AND label = r.wanted)::INT) AS BIGINT) AS top1, round(count(*) FILTER (label = r.wanted AND rank <= 6) / least(any_value(relevant), 6), 6) AS recall6 FROM r JOIN n USING (wanted) WHERE rank <= 10 GROUP BY query_id""")
def topic_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well vectors find their own topic."""
    e = table(spark, d, "embeddings")
    labels = e.select("vec_id", "label")
    ranked = _many(spark, d, 10).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    total = labels.groupBy(F.col("label").alias("wanted")).agg(F.count(F.lit(1)).alias("relevant"))
    return M.topic_metrics(ranked, "query_id", "label", "wanted", total).select("query_id", F.col("top1").cast("bigint").alias("top1"), F.round("recall6", 6).alias("recall6"))


@R.add("""WITH i AS (SELECT query_id, min(coalesce(query_language, '')) AS query_language FROM eval_queries WHERE query_id IS NOT NULL GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query_language ORDER BY sha256('round-1|' || query_language || '|' || query_id), query_id) AS position, count(*) OVER (PARTITION BY query_language) AS n FROM i)
SELECT query_id, query_language, position, CASE WHEN position <= ceil(n * 0.6) THEN 'development' WHEN position <= ceil(n * 1.0) THEN 'held_out' END AS part FROM k""")
def hash_partitions(spark: SparkSession, d: str) -> DataFrame:
    got = M.hash_partition(table(spark, d, "eval_queries"), "query_id", "query_language", "round-1", [("development", 0.6), ("held_out", 0.4)])
    return got.select("query_id", "query_language", F.col("position").cast("bigint").alias("position"), "part")


@R.add(f"WITH {BLOCKS} SELECT extraction_method, count(*) FILTER (o = 'passed') AS passed, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'unsupported') AS unsupported, count(*) AS total, round(count(*) FILTER (o = 'passed') / (count(*) FILTER (o = 'passed') + count(*) FILTER (o = 'failed')), 6) AS score FROM (SELECT extraction_method, CASE WHEN is_table THEN 'unsupported' WHEN length(text) > 100 THEN 'passed' ELSE 'failed' END AS o FROM b) GROUP BY 1")
def outcome_shares(spark: SparkSession, d: str) -> DataFrame:
    o = F.when(F.col("is_table"), "unsupported").when(F.length("text") > 100, "passed").otherwise("failed")
    return M.outcome_shares(blocks(spark, d).withColumn("o", o), "extraction_method", "o", ["passed", "failed", "unsupported"]).withColumn("score", F.round("score", 6))


@R.add(f"""WITH {BLOCKS}, r AS (SELECT block_id, i AS row_no, string_split(string_split(text, chr(10))[i], chr(9)) AS cells FROM b, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) WHERE is_table),
c AS (SELECT block_id, row_no, k AS col_no, cells[k] AS text FROM r, LATERAL (SELECT unnest(range(1, len(cells) + 1)) AS k))
SELECT block_id, row_no, col_no, text, lag(text) OVER a AS "left", lead(text) OVER a AS "right", lag(text) OVER d AS up, lead(text) OVER d AS down, first_value(text) OVER d AS heading FROM c WINDOW a AS (PARTITION BY block_id, row_no ORDER BY col_no), d AS (PARTITION BY block_id, col_no ORDER BY row_no)""")
def table_relations(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks(spark, d).where("is_table").select("block_id", F.posexplode(F.split("text", "\n")).alias("r", "t"))
    cells = rows.select("block_id", (F.col("r") + 1).cast("bigint").alias("row_no"), F.posexplode(F.split("t", "\t")).alias("c", "text")).select("block_id", "row_no", (F.col("c") + 1).cast("bigint").alias("col_no"), "text")
    return M.table_relations(cells, ["block_id"], "row_no", "col_no", "text")


@R.add()
def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    m = ranking_metrics(spark, d)
    return M.paired_bootstrap(m.withColumn("cluster", F.col("query_id") % 20), "cluster", "recall", "ndcg", 500)
