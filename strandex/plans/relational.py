"""Inventory, jobs, issues, trees and paging over the test tables.

The events table stands for a log of jobs: user_id is the document, event_type the state, event_id the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import inventory as I
from ..operators import issues as S
from ..operators import trees
from .common import Registry, table
from .search import passages

R = Registry()

STATE = {"error": "failed", "signup": "queued", "view": "running", "click": "completed", "purchase": "retry_wait"}
JOBS = "j AS (SELECT event_id AS job_id, ts, user_id AS document_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE.items()) + " END AS state, value, props FROM events)"
PASS = "p AS (SELECT DISTINCT ON (id) * EXCLUDE (ingested_at) FROM passages)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in STATE.items() for x in kv])
    return table(spark, d, "events").select(F.col("event_id").alias("job_id"), "ts", F.col("user_id").alias("document_id"), m[F.col("event_type")].alias("state"), "value", "props")


@R.add(f"""WITH {JOBS} SELECT document_id % 10 AS project_id, count(*) AS total, {', '.join(f"count(*) FILTER (state = '{s}') AS n_{s}" for s in STATE.values())}, min(ts) FILTER (state = 'retry_wait') AS next_retry,
count(DISTINCT document_id) FILTER (state = 'failed') AS failed_documents FROM j GROUP BY 1""")
def project_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.summary(jobs(spark, d).withColumn("project_id", F.col("document_id") % 10), ["project_id"], "state", list(STATE.values()), "ts", "document_id", "failed")


@R.add(f"WITH {PASS} SELECT CASE WHEN lower(file_name) LIKE '%.tar.gz' THEN '.tar.gz' ELSE regexp_extract(lower(file_name), '(\\.[^./\\\\]+)$', 1) END AS extension, count(*) AS n FROM (SELECT DISTINCT document_id, file_name FROM p) GROUP BY 1")
def file_types(spark: SparkSession, d: str) -> DataFrame:
    return I.value_counts(table(spark, d, "passages").select("document_id", "file_name").distinct(), I.extension(F.col("file_name")), "extension")


@R.add(f"WITH {PASS} SELECT revision_id, count(*) AS passages, count(DISTINCT content_id) AS contents, count(*) FILTER (extraction_method = 'Ocr') AS ocr_passages, count(*) FILTER (semantic_eligible) AS eligible FROM p GROUP BY 1")
def content_counts(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).groupBy("revision_id").agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("content_id").alias("contents"), F.count_if(F.col("extraction_method") == "Ocr").alias("ocr_passages"), F.count_if("semantic_eligible").alias("eligible"))


@R.add(f"WITH {PASS} SELECT document_id, string_agg(extraction_method || '=' || n, ',' ORDER BY extraction_method) AS methods FROM (SELECT document_id, extraction_method, count(*) AS n FROM p WHERE extraction_method IS NOT NULL GROUP BY ALL) GROUP BY 1")
def extraction_methods(spark: SparkSession, d: str) -> DataFrame:
    got = I.histogram(passages(spark, d), ["document_id"], "extraction_method", "m")
    return got.select("document_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("methods"))


@R.add(f"WITH {JOBS} SELECT document_id, job_id, ts, state FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY state IN ('queued', 'running', 'retry_wait') DESC, ts DESC, job_id DESC) AS n FROM j) WHERE n = 1")
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    """Each document's job of interest: an open one if there is any, else the last."""
    j = jobs(spark, d).select("document_id", "job_id", "ts", "state")
    return I.latest_by(j, ["document_id"], [F.col("state").isin("queued", "running", "retry_wait"), F.col("ts"), F.col("job_id")])


@R.add(f"WITH {JOBS} SELECT document_id, job_id, ts, errors FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, job_id DESC) AS n, count(*) OVER (PARTITION BY document_id) AS errors FROM j WHERE state = 'failed') WHERE n = 1")
def latest_error(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).where("state = 'failed'").select("document_id", "job_id", "ts")
    return I.latest_by(j, ["document_id"], [F.col("ts"), F.col("job_id")], "errors")


@R.add(f"WITH {JOBS} SELECT document_id, job_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, job_id DESC) AS n FROM j WHERE state IN ('completed', 'failed')) WHERE n <= 3")
def pruned_history(spark: SparkSession, d: str) -> DataFrame:
    """The newest three ended jobs of each document."""
    j = jobs(spark, d).where("state IN ('completed', 'failed')").select("document_id", "job_id", "ts")
    return I.newest(j, ["document_id"], [F.col("ts").desc(), F.col("job_id").desc()], 3)


_INVENTORY = f"""WITH {PASS}, {JOBS}, doc AS (SELECT document_id, min(file_name) AS file_name, max(modified_utc) AS modified_utc, count(*) AS passages, row_number() OVER (ORDER BY document_id) - 1 AS k FROM p GROUP BY document_id),
lj AS (SELECT document_id, state FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY state IN ('queued', 'running', 'retry_wait') DESC, ts DESC, job_id DESC) AS n FROM j) WHERE n = 1),
le AS (SELECT document_id, count(*) AS errors, arg_max(job_id, (ts, job_id)) AS last_error FROM j WHERE state = 'failed' GROUP BY 1),
inv AS (SELECT doc.document_id, file_name, doc.modified_utc, passages, state, coalesce(errors, 0) AS errors, last_error, CASE WHEN state = 'running' THEN 'indexing' WHEN state IN ('queued', 'retry_wait') THEN 'pending' WHEN state = 'failed' OR coalesce(errors, 0) > 0 THEN 'error' ELSE 'ready' END AS status
FROM doc LEFT JOIN lj ON lj.document_id = doc.k LEFT JOIN le ON le.document_id = doc.k)"""


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    doc = passages(spark, d).groupBy("document_id").agg(F.min("file_name").alias("file_name"), F.max("modified_utc").alias("modified_utc"), F.count(F.lit(1)).alias("passages"))
    # the log's documents are numbers: the k-th document in order stands for number k
    doc = doc.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("document_id")) - 1)
    j = jobs(spark, d)
    lj = I.latest_by(j.select("document_id", "job_id", "ts", "state"), ["document_id"], [F.col("state").isin("queued", "running", "retry_wait"), F.col("ts"), F.col("job_id")]).select(F.col("document_id").alias("k"), "state")
    le = I.latest_by(j.where("state = 'failed'").select("document_id", "job_id", "ts"), ["document_id"], [F.col("ts"), F.col("job_id")], "errors").select(F.col("document_id").alias("k"), "errors", F.col("job_id").alias("last_error"))
    out = doc.join(lj, "k", "left").join(le, "k", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return out.withColumn("status", I.document_status(F.coalesce("state", F.lit("")), F.col("errors"), F.lit(True))).drop("k")


@R.add(_INVENTORY + " SELECT * FROM inv")
def document_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Documents with counts, their job's state, errors and the status shown."""
    return _inventory(spark, d)


@R.add(_INVENTORY + " SELECT document_id, file_name, modified_utc, status FROM inv WHERE (status = 'error' OR errors > 0) AND (lower(file_name) LIKE '%.pdf' OR lower(file_name) LIKE '%.docx') AND contains(upper(file_name), 'RA')")
def inventory_filter(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("file_name")
    return _inventory(spark, d).where(((F.col("status") == "error") | (F.col("errors") > 0)) & I.extension(name).isin(".pdf", ".docx") & X.contains_fold(name, F.lit("ra"))).select("document_id", "file_name", "modified_utc", "status")


@R.add(_INVENTORY + " SELECT document_id, passages, errors FROM inv ORDER BY passages DESC, document_id LIMIT 11")
def keyset_first_page(spark: SparkSession, d: str) -> DataFrame:
    return I.keyset_page(_inventory(spark, d).select("document_id", "passages", "errors"), [("passages", False), ("document_id", True)], None, 10)


@R.add(_INVENTORY + " SELECT document_id, last_error FROM inv WHERE (last_error IS NULL AND document_id > '8') OR last_error IS NOT NULL ORDER BY last_error ASC NULLS FIRST, document_id LIMIT 26")
def keyset_after_null(spark: SparkSession, d: str) -> DataFrame:
    """A page that begins after a row whose key is null: nulls come first in ascending order."""
    return I.keyset_page(_inventory(spark, d).select("document_id", "last_error"), [("last_error", True), ("document_id", True)], [None, "8"], 25)


@R.add("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE (o_orderdate < TIMESTAMP '1998-01-01') OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey > 500) OR o_orderdate IS NULL ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 51")
def keyset_page_orders(spark: SparkSession, d: str) -> DataFrame:
    import datetime

    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return I.keyset_page(rows, [("o_orderdate", False), ("o_orderkey", True)], [datetime.datetime(1998, 1, 1), 500], 50)


@R.add("SELECT DISTINCT id, ordinal FROM sections ORDER BY ordinal, id LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return I.offset_page(table(spark, d, "sections").select("id", "ordinal").distinct(), [F.col("ordinal"), F.col("id")], 40, 20)


@R.add(f"WITH {JOBS} SELECT job_id, document_id, ts FROM j WHERE state IN ('queued', 'retry_wait') AND document_id NOT IN (SELECT document_id FROM j WHERE state = 'running' AND job_id % 7 = 0) ORDER BY ts, job_id LIMIT 10")
def queue_head(spark: SparkSession, d: str) -> DataFrame:
    """The oldest ready jobs of documents that are not excluded."""
    j = jobs(spark, d)
    excluded = j.where("state = 'running' AND job_id % 7 = 0").select("document_id").distinct()
    return j.where("state IN ('queued', 'retry_wait')").join(excluded, "document_id", "left_anti").select("job_id", "document_id", "ts").orderBy("ts", "job_id").limit(10)


@R.add(f"""WITH {JOBS} SELECT job_id, CASE WHEN state <> 'running' THEN state WHEN value > 5 AND job_id % 8 <= 5 THEN 'retry_wait' ELSE 'failed' END AS next_state,
CASE WHEN state = 'running' AND value > 5 AND job_id % 8 <= 5 THEN ts + to_seconds(CASE WHEN job_id % 8 <= 1 THEN 5 WHEN job_id % 8 = 2 THEN 30 WHEN job_id % 8 = 3 THEN 120 WHEN job_id % 8 = 4 THEN 600 ELSE 3600 END) END AS next_try FROM j""")
def failed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """State and next try of each job when it fails: five retries, ever later."""
    j = jobs(spark, d)
    state, at = I.fail_job(F.col("state"), F.col("job_id") % 8, F.col("value") > 5, F.col("ts"))
    return j.select("job_id", state.alias("next_state"), at.alias("next_try"))


@R.add(f"WITH {JOBS} SELECT document_id, min(ts) AS ts, CASE WHEN max((state = 'failed')::INT) = 1 THEN 'reindex' ELSE 'index' END AS kind, count(*) AS requests FROM j WHERE state IN ('failed', 'queued') GROUP BY 1")
def open_jobs(spark: SparkSession, d: str) -> DataFrame:
    """One open job for each document of many requests; re-indexing wins."""
    r = jobs(spark, d).where("state IN ('failed', 'queued')").withColumn("kind", F.when(F.col("state") == "failed", "reindex").otherwise("index"))
    return I.merge_open_jobs(r, "document_id", "kind", "ts")


# Joins


@R.add("SELECT DISTINCT id FROM manifest WHERE id NOT IN (SELECT id FROM manifest WHERE batch_no >= 3)")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Rows of earlier deliveries that the later listing no longer has."""
    m = table(spark, d, "manifest")
    return I.missing(m.select("id").distinct(), m.where("batch_no >= 3"), ["id"])


@R.add("""WITH m AS (SELECT doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL), a AS (SELECT h, min(doc_id) AS old FROM m WHERE doc_id % 2 = 0 GROUP BY h HAVING count(*) = 1),
b AS (SELECT h, min(doc_id) AS "new" FROM m WHERE doc_id % 2 = 1 GROUP BY h HAVING count(*) = 1) SELECT old, "new" FROM a JOIN b USING (h)""")
def rename_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents of even ids taken for gone and of odd ids for new: those with one content and no other choice."""
    m = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("h"))
    return I.renames(m.where("doc_id % 2 = 0"), m.where("doc_id % 2 = 1"), "h", "doc_id")


@R.add(f"WITH {PASS}, a AS (SELECT content_id, ordinal FROM p WHERE extraction_method = 'Ocr' AND ocr_confidence < 85) SELECT DISTINCT p.id, p.content_id, p.ordinal FROM p JOIN a ON p.content_id = a.content_id AND p.ordinal BETWEEN a.ordinal - 2 AND a.ordinal + 1")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of uncertain passages in their content."""
    p = passages(spark, d)
    return I.context_window(p.select("id", "content_id", "ordinal"), p.where("extraction_method = 'Ocr' AND ocr_confidence < 85"), "content_id", "ordinal", 2, 1)


@R.add(f"""WITH {PASS}, s AS (SELECT DISTINCT id AS section_id, CAST(strpos(display_text, '. ') AS BIGINT) AS a FROM sections WHERE strpos(display_text, '. ') > 0)
SELECT s.section_id, a - 1 AS span_start, p.id AS passage_id FROM s JOIN p ON p.section_id = s.section_id AND a - 1 < p.section_offset + length(p.display_text) AND a + 20 > p.section_offset""")
def span_members(spark: SparkSession, d: str) -> DataFrame:
    """Passages that a span of their section overlaps."""
    at = F.instr("display_text", ". ")
    spans = table(spark, d, "sections").where(at > 0).select(F.col("id").alias("section_id"), at.cast("bigint").alias("a")).distinct().select("section_id", (F.col("a") - 1).alias("span_start"), (F.col("a") + 20).alias("span_end"))
    members = passages(spark, d).select("section_id", F.col("id").alias("passage_id"), F.col("section_offset").alias("offset"), F.length("display_text").alias("size"))
    return I.span_members(spans, members, "section_id", "span_start", "span_end", "offset", "size").select("section_id", "span_start", "passage_id")


@R.add(f"WITH {PASS}, f AS (SELECT section_id, arg_min(title, (ordinal, id)) AS title, arg_min(file_name, (ordinal, id)) AS file_name FROM p WHERE section_id IS NOT NULL GROUP BY 1) SELECT s.id, f.file_name FROM (SELECT DISTINCT id FROM sections) s JOIN f ON f.section_id = s.id")
def section_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Sections with the metadata of their first passage: the least ordinal, gathered by a partial aggregate."""
    first = passages(spark, d).where("section_id IS NOT NULL").groupBy("section_id").agg(F.min_by("file_name", F.struct("ordinal", "id")).alias("file_name"))
    return table(spark, d, "sections").select("id").distinct().join(first, F.col("id") == F.col("section_id")).select("id", "file_name")


@R.add(f"WITH {PASS} SELECT id FROM p WHERE (source_path = '/projects/sotex' OR source_path LIKE '/projects/sotex/%' OR source_path LIKE '/projects/rever/%' OR source_path = '/projects/rever' OR source_path LIKE '/projects/tove/%') AND (lower(file_name) LIKE '%.pdf' OR lower(file_name) LIKE '%.docx') AND modified_utc BETWEEN TIMESTAMPTZ '2023-06-01 00:00:00+00' AND TIMESTAMPTZ '2025-06-01 00:00:00+00'")
def search_filters(spark: SparkSession, d: str) -> DataFrame:
    """Path, extension and time filters, as one condition that reaches the scan."""
    import datetime

    utc = datetime.timezone.utc
    f = I.search_filter(["/projects/sotex", "/projects/rever/", "/projects/tove"], [".pdf", ".docx"], (datetime.datetime(2023, 6, 1, tzinfo=utc), datetime.datetime(2025, 6, 1, tzinfo=utc)))
    return table(spark, d, "passages").where(f).select("id").distinct()


# Issues

_ERR = f"{JOBS}, e AS (SELECT document_id, state AS code, 'part-' || (job_id % 3) AS component, CASE WHEN job_id % 2 = 0 THEN 'part-' || (job_id % 3) || ': ' ELSE '' END || 'value ' || (job_id % 5) AS message, ts, value FROM j WHERE state IN ('failed', 'retry_wait'))"
_SIG = "concat(length(CAST(document_id AS VARCHAR)), ':', document_id, ';', length(code), ':', code, ';', length(component), ':', component, ';', length(c), ':', c, ';0:;')"
_SIGNED = f"{_ERR}, s AS (SELECT *, {_SIG} AS signature FROM (SELECT *, CASE WHEN starts_with(message, component || ': ') THEN substr(message, length(component) + 3) ELSE message END AS c FROM e))"


def _errors(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).where("state IN ('failed', 'retry_wait')")
    part = F.concat(F.lit("part-"), (F.col("job_id") % 3).cast("string"))
    text = F.concat(F.when(F.col("job_id") % 2 == 0, F.concat(part, F.lit(": "))).otherwise(F.lit("")), F.lit("value "), (F.col("job_id") % 5).cast("string"))
    return S.with_signature(j.select("document_id", F.col("state").alias("code"), part.alias("component"), text.alias("message"), "ts", "value"), "document_id", "code", "component", "message")


@R.add(f"WITH {_SIGNED} SELECT signature, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrences FROM s GROUP BY 1")
def issue_lifecycles(spark: SparkSession, d: str) -> DataFrame:
    """History of each issue, made in two deliveries."""
    e = _errors(spark, d)
    early = S.upsert_lifecycles(None, e.where("ts < '2024-01-15'"), ["signature"], "ts")
    return S.upsert_lifecycles(early, e.where("ts >= '2024-01-15'"), ["signature"], "ts")


@R.add(f"WITH {_SIGNED} SELECT signature, count(*) AS n FROM s WHERE signature NOT IN (SELECT signature FROM s WHERE value > 60) GROUP BY 1")
def unacknowledged_issues(spark: SparkSession, d: str) -> DataFrame:
    e = _errors(spark, d)
    return S.unacknowledged(e, e.where("value > 60"), ["signature"])


@R.add(f"WITH {_SIGNED} SELECT document_id, count(*) AS issues, max(value) AS weight, max(ts) AS latest, CAST(CASE WHEN max((code = 'failed' AND value > 90)::INT) = 1 THEN 3 WHEN max((code = 'failed')::INT) = 1 THEN 2 ELSE 1 END AS BIGINT) AS impact FROM s GROUP BY 1")
def issue_groups(spark: SparkSession, d: str) -> DataFrame:
    e = _errors(spark, d)
    got = S.groups(e, "document_id", F.col("value"), (F.col("code") == "failed") & (F.col("value") > 90), F.col("code") == "failed", "ts")
    return got.withColumn("impact", F.col("impact").cast("bigint"))


@R.add(f"WITH {_SIGNED} SELECT count(*) AS all_issues, count(*) FILTER (contains(lower(message), 'value 3') AND code = 'failed') AS shown_issues FROM s")
def issue_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.totals(_errors(spark, d), F.contains(F.lower("message"), F.lit("value 3")) & (F.col("code") == "failed"))


@R.add(f"WITH {_ERR} SELECT DISTINCT document_id, code, CASE WHEN length(t) > 300 THEN substr(t, 1, 297) || '...' ELSE t END AS summary FROM (SELECT document_id, code, trim(regexp_replace(code || ': ' || repeat(message || '  ', 1 + CAST(document_id % 40 AS INT)), '\\s+', ' ', 'g')) AS t FROM e)")
def error_summaries(spark: SparkSession, d: str) -> DataFrame:
    e = _errors(spark, d)
    long = F.repeat(F.concat("message", F.lit("  ")), (F.col("document_id") % 40 + 1).cast("int"))
    return e.select("document_id", "code", X.error_summary(F.col("code"), long).alias("summary")).distinct()


# Trees: regions hold nations, nations customers, customers orders

_NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name, r_regionkey AS ord FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, c_custkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority, o_orderkey FROM orders)"""
_TREE = f"""WITH RECURSIVE {_NODES}, t AS (SELECT id, parent, name, 0 AS depth, CAST([] AS VARCHAR[]) AS chain, [id] AS path, printf('%08d', CAST(ord AS INT)) AS sort_path FROM nodes WHERE parent IS NULL
UNION ALL SELECT n.id, n.parent, n.name, depth + 1, list_append(chain, n.name), list_append(path, n.id), sort_path || '.' || printf('%08d', CAST(n.ord AS INT)) FROM nodes n JOIN t ON n.parent = t.id)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, tag, key, up, tag_up, label: table(spark, d, name).select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("id"), (F.concat(F.lit(tag_up), F.col(up).cast("string")) if up else F.lit(None).cast("string")).alias("parent"), F.col(label).alias("name"), F.col(key).cast("bigint").alias("ord"))
    return (part("region", "r", "r_regionkey", None, "", "r_name").unionByName(part("nation", "n", "n_nationkey", "n_regionkey", "r", "n_name"))
            .unionByName(part("customer", "c", "c_custkey", "c_nationkey", "n", "c_name")).unionByName(part("orders", "o", "o_orderkey", "o_custkey", "c", "o_orderpriority")))


@R.add(_TREE + " SELECT id, CAST(depth AS BIGINT) AS depth, array_to_string(chain, ' / ') AS chain FROM t")
def ancestor_chains(spark: SparkSession, d: str) -> DataFrame:
    t = trees.expand(_nodes(spark, d), "id", "parent", "name", "ord", 3)
    return t.select("id", F.col("depth").cast("bigint").alias("depth"), F.array_join("chain", " / ").alias("chain"))


@R.add(_TREE + " SELECT a AS id, count(*) AS descendants FROM (SELECT unnest(path[1:len(path) - 1]) AS a FROM t) GROUP BY 1")
def descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return trees.descendants(trees.expand(_nodes(spark, d), "id", "parent", "name", "ord", 3))


@R.add(_TREE + " SELECT id, sort_path FROM t ORDER BY sort_path LIMIT 100 OFFSET 200")
def preorder_page(spark: SparkSession, d: str) -> DataFrame:
    return I.offset_page(trees.expand(_nodes(spark, d), "id", "parent", "name", "ord", 3).select("id", "sort_path"), [F.col("sort_path")], 200, 100)


@R.add(f"WITH RECURSIVE {_NODES}, up AS (SELECT id, parent AS ancestor, 1 AS steps FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT up.id, n.parent, steps + 1 FROM up JOIN nodes n ON n.id = up.ancestor WHERE n.parent IS NOT NULL) SELECT id, ancestor, CAST(steps AS BIGINT) AS steps FROM up")
def recursive_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return trees.recursive_ancestors(_nodes(spark, d), "id", "parent").select("id", "ancestor", F.col("steps").cast("bigint").alias("steps"))


@R.add(f"WITH {_NODES} SELECT id, row_number() OVER (PARTITION BY parent, name ORDER BY ord) - 1 AS occurrence FROM nodes")
def sibling_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return trees.sibling_occurrences(_nodes(spark, d), "parent", ["name"], "ord").select("id", F.col("occurrence").cast("bigint").alias("occurrence"))
