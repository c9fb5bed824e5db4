"""What the plans whose results SQL cannot make must keep, as rows that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from .common import Registry, table
from .evidence import BLOCKS, LINES, blocks, chunks, lines, previews, reading_order, text_quality
from .search import passages
from .state import job_states, paged_groups, passages_of_documents

R = Registry()


@R.add("SELECT id, true AS literal, true AS in_order, true AS whole FROM (SELECT DISTINCT id, display_text FROM sections) WHERE length(regexp_replace(display_text, '\\s+', '', 'g')) > 0")
def chunks_kept(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are literally what stands at their place, follow each other, and leave nothing but blanks of their section out."""
    s = table(spark, d, "sections").select("id", "display_text").distinct()
    c = chunks(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "start", "text"))).alias("c"))
    blank = lambda a, b: F.trim(F.regexp_replace(F.substring(F.col("display_text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), r"(?U)\s+", "")) == ""
    literal = F.forall("c", lambda x: F.substring(F.col("display_text"), (x["start"] + 1).cast("int"), F.length(x["text"])) == x["text"])
    ordered = F.forall(F.sequence(F.lit(1), F.size("c")), lambda i: F.when(i == 1, True).otherwise(F.get("c", i - 1)["start"] >= F.get("c", i - 2)["start"]))
    end = F.length("display_text").cast("bigint")
    reached = F.aggregate("c", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(True).alias("ok")), lambda a, x: F.struct(F.greatest(a["at"], x["start"] + F.length(x["text"])).alias("at"), (a["ok"] & blank(a["at"], x["start"])).alias("ok")))
    return s.join(c, "id").select("id", literal.alias("literal"), ordered.alias("in_order"), (reached["ok"] & blank(reached["at"], end)).alias("whole"))


@R.add(f"WITH {LINES} SELECT document_id, CAST(page_number AS BIGINT) AS page_number, count(*) AS lines, true AS complete FROM l GROUP BY ALL")
def reading_order_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a page has one place in its order."""
    got = reading_order(spark, d).groupBy("document_id", "page_number").agg(F.count_distinct("line_id").alias("lines"), F.count_distinct("position").alias("n"), (F.max("position") - F.min("position") + 1).alias("span"))
    return got.select("document_id", F.col("page_number").cast("bigint").alias("page_number"), "lines", ((F.col("n") == F.col("lines")) & (F.col("span") == F.col("lines"))).alias("complete"))


_CLEAN = "^[a-z]{1,20}( [a-z]{1,20})*[.]?$"


@R.add(f"WITH {BLOCKS} SELECT block_id, CASE WHEN regexp_full_match(text, '{_CLEAN[1:-1]}') THEN 'clean' ELSE 'any' END AS kind, true AS fits FROM b WHERE length(text) > 0")
def text_quality_kept(spark: SparkSession, d: str) -> DataFrame:
    """Qualities lie between 0 and 1, and plain words have 1."""
    got = text_quality(spark, d).join(blocks(spark, d).where("length(text) > 0").select("block_id", F.when(F.col("text").rlike(_CLEAN), "clean").otherwise("any").alias("kind")), "block_id")
    return got.select("block_id", "kind", ((F.col("quality") >= 0) & (F.col("quality") <= 1) & ((F.col("kind") == "any") | (F.col("quality") == 1))).alias("fits"))


@R.add("SELECT true AS literal, true AS short, true AS few, true AS any")
def previews_kept(spark: SparkSession, d: str) -> DataFrame:
    """Previews are literal, of 800 characters at most, two a group at most, and there are some."""
    shown = previews(spark, d).join(passages(spark, d, "display_text"), "id").withColumn("ok", M.literal_citation(F.col("display_text"), F.col("start"), F.col("length"), F.col("excerpt")))
    each = shown.groupBy("content_id").agg(F.min("ok").alias("ok"), F.max("length").alias("l"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.min("ok").alias("literal"), (F.max("l") <= 800).alias("short"), (F.max("n") <= 2).alias("few"), (F.count(F.lit(1)) > 0).alias("any"))


@R.add("SELECT true AS places, true AS small, true AS diverse")
def paged_groups_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every group is on one page of five at most, and no page has two groups of a document."""
    from .search import _groups

    got = paged_groups(spark, d).join(_groups(spark, d)[1].select("content_id", "document_id"), "content_id")
    pages = got.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("k"))
    places = got.agg((F.count_distinct("position") == F.count(F.lit(1))).alias("places"))
    return pages.agg((F.max("n") <= 5).alias("small"), F.min(F.col("n") == F.col("k")).alias("diverse")).join(places).select("places", "small", "diverse")  # one row each


@R.add("SELECT user_id AS document_id, count(*) FILTER (event_type IN ('signup', 'purchase')) AS epoch FROM events GROUP BY 1")
def job_epochs(spark: SparkSession, d: str) -> DataFrame:
    """A document's epoch rises with each event that changes it."""
    return job_states(spark, d).select("document_id", "epoch")


@R.add("SELECT doc_id, true AS numbered, true AS unique_ids, true AS filled FROM documents WHERE length(regexp_replace(text, '[\\s\\p{Cf}\\p{Cc}]+', '', 'g')) > 0")
def passages_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text have passages with text, numbered without gaps, with ids of their own."""
    p = passages_of_documents(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ordinal").alias("k"), (F.max("ordinal") - F.min("ordinal") + 1).alias("span"), F.count_distinct("id").alias("ids"), F.min(F.length(F.trim("display_text")) > 0).alias("filled"))
    return p.select("doc_id", ((F.col("k") == F.col("n")) & (F.col("span") == F.col("n"))).alias("numbered"), (F.col("ids") == F.col("n")).alias("unique_ids"), "filled")


@R.add(f"WITH {LINES}, x AS (SELECT line_id, text, lead(text) OVER (PARTITION BY document_id, page_number ORDER BY line_no, line_id) AS nxt FROM l) SELECT line_id, true AS fits FROM x WHERE nxt IS NOT NULL AND length(text) > 0")
def error_rates_kept(spark: SparkSession, d: str) -> DataFrame:
    """Rates of character errors lie between the difference of the lengths and the longer length, over the reference's; equal texts have 0."""
    from pyspark.sql import Window

    from .evidence import character_error_rate

    w = Window.partitionBy("document_id", "page_number").orderBy("line_no", "line_id")
    x = lines(spark, d).select("line_id", "text", F.lead("text").over(w).alias("nxt")).where("nxt IS NOT NULL AND length(text) > 0").join(character_error_rate(spark, d), "line_id")
    n, m = F.length("text"), F.length("nxt")
    return x.select("line_id", ((F.col("cer") >= F.abs(n - m) / n - 1e-6) & (F.col("cer") <= F.greatest(n, m) / n + 1e-6) & ((F.col("text") != F.col("nxt")) | (F.col("cer") == 0))).alias("fits"))
