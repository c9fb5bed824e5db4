"""State changes, ingestion and evidence operators over the test tables.

Manifest rows stand for files: deliveries up to batch 3 are what is known, later ones what is observed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..operators import inventory as I
from ..operators import metrics as M
from ..operators import sections as S
from ..operators.vectors import hashing_embedder
from ..service import paged
from ..sources.extract import flatten_json
from ..sources.formats import BY_EXTENSION
from ..streaming import events as E
from .common import Registry, table
from .relational import _errors, jobs
from .search import _groups, passages

R = Registry()

_JOBS = "j AS (SELECT event_id AS job_id, ts, user_id AS document_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'retry_wait' END AS state FROM events)"
_FILES = """a AS (SELECT id, min(file_name) AS file_name, min(coalesce(minimum_characters, 0)) AS size, min(added_at) AS t FROM manifest WHERE batch_no <= 3 GROUP BY id),
b AS (SELECT id, min(file_name) AS file_name, min(coalesce(minimum_characters, 0)) + (CASE WHEN length(id) % 2 = 0 THEN 1 ELSE 0 END) AS size, min(added_at) AS t FROM manifest WHERE batch_no >= 2 GROUP BY id)"""


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, d, "manifest")
    one = lambda c, more: m.where(c).groupBy("id").agg(F.min("file_name").alias("file_name"), (F.min(F.coalesce("minimum_characters", F.lit(0))) + more).cast("long").alias("size"), F.min("added_at").alias("modified_utc"))
    base = lambda df: df.select("id", F.lit("p").alias("project_id"), F.lit("f").alias("folder_id"), F.col("id").alias("path"), F.col("id").alias("path_key"), "file_name", F.regexp_extract("file_name", r"(\.[^.]*)$", 1).alias("extension"), "size", "modified_utc")
    known = base(one("batch_no <= 3", F.lit(0))).withColumns({"sha256": F.lit(None).cast("string"), "observation_epoch": F.lit(1).cast("long"), "tombstoned": F.lit(False), "available": F.lit(True), "active_revision_id": F.col("id")})
    return known, base(one("batch_no >= 2", F.when(F.length("id") % 2 == 0, 1).otherwise(0)))


@R.add(f"WITH {_FILES} SELECT coalesce(a.id, b.id) AS id, coalesce(b.size, a.size)::BIGINT AS size, CAST(CASE WHEN a.id IS NULL THEN 1 WHEN b.id IS NOT NULL AND (a.size <> b.size OR a.t <> b.t) THEN 2 ELSE 1 END AS BIGINT) AS observation_epoch FROM a FULL JOIN b ON a.id = b.id")
def observed_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents after a listing was observed: new files added, changed ones with a higher epoch."""
    docs, _ = store.observe(*_known(spark, d))
    return docs.select("id", "size", "observation_epoch")


@R.add(f"WITH {_FILES} SELECT a.id, CAST(CASE WHEN b.id IS NULL THEN 2 ELSE 1 END AS BIGINT) AS observation_epoch, b.id IS NULL AS tombstoned FROM a LEFT JOIN b ON a.id = b.id")
def tombstoned_files(spark: SparkSession, d: str) -> DataFrame:
    """Known documents that a whole listing no longer has are marked as deleted."""
    known, seen = _known(spark, d)
    gone = store.reconcile(known, seen, seen.select("folder_id").distinct())
    return store.tombstone(known, gone).select("id", "observation_epoch", "tombstoned")


@R.add(f"""WITH {_JOBS}, r AS (SELECT job_id FROM j WHERE (state = 'queued') OR (state = 'retry_wait' AND ts <= TIMESTAMP '2024-01-20') OR (state = 'running' AND ts + INTERVAL 20 MINUTE < TIMESTAMP '2024-01-20') ORDER BY ts, job_id LIMIT 25)
SELECT job_id, CASE WHEN r.job_id IS NOT NULL THEN 'running' ELSE state END AS state, CAST(CASE WHEN r.job_id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS attempt FROM j LEFT JOIN r USING (job_id)""")
def leased_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The 25 oldest ready jobs under a lease; leases that ran out are ready again."""
    j = jobs(spark, d).select(F.col("job_id").alias("id"), F.lit("p").alias("project_id"), "document_id", F.lit("index").alias("kind"), "state", F.lit(0).cast("long").alias("expected_epoch"), F.lit(0).alias("attempt"), F.col("ts").cast("timestamp").alias("created_utc"),
                              F.when(F.col("state") == "retry_wait", F.col("ts").cast("timestamp")).alias("not_before"), F.when(F.col("state") == "running", F.col("ts").cast("timestamp") + F.expr("INTERVAL 20 MINUTES")).alias("lease_until"))
    return store.lease(j, F.lit("2024-01-20").cast("timestamp"), 25).select(F.col("id").alias("job_id"), "state", F.col("attempt").cast("bigint").alias("attempt"))


@R.add("WITH p AS (SELECT DISTINCT id, revision_id, document_id, semantic_eligible, ordinal FROM passages) SELECT DISTINCT document_id FROM p WHERE semantic_eligible AND ordinal % 4 = 1")
def documents_to_embed(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage that lacks a vector of the policy; a quarter of the passages have one of an older policy."""
    p = passages(spark, d)
    vectors = p.select(F.col("id").alias("passage_id"), "revision_id", F.when(F.col("ordinal") % 4 == 1, "old").otherwise("now").alias("policy_key"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    return store.needs_refresh(p, vectors, "now", 2)


@R.add("""WITH e AS (SELECT DISTINCT 'c' || c_custkey || '/' || o_orderkey AS component, c_nationkey AS document_id, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT component, document_id, CASE WHEN c_custkey % 3 <> 0 THEN 'n' || c_custkey END AS content_id FROM e""")
def bound_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors bound to the content whose key begins their component: two thirds of the customers are contents, their orders components."""
    c = table(spark, d, "customer")
    e = c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("c"), "c_custkey", F.lit("/"), "o_orderkey").alias("component"), F.col("c_nationkey").alias("document_id")).distinct()
    nodes = c.where("c_custkey % 3 <> 0").select(F.col("c_nationkey").alias("document_id"), F.concat(F.lit("n"), "c_custkey").alias("content_id"), F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").alias("name"))
    return store.bind_errors(e, nodes).select("component", "document_id", "content_id")


@R.add(f"WITH {_JOBS} SELECT job_id, document_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, job_id DESC) AS n FROM j WHERE state IN ('completed', 'failed')) WHERE n = 1 UNION ALL SELECT job_id, document_id, ts FROM j WHERE state NOT IN ('completed', 'failed')")
def pruned_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).withColumn("id", F.col("job_id")).withColumn("created_utc", F.col("ts"))
    return store.prune_jobs(j).select("job_id", "document_id", "ts")


@R.add(f"WITH {_JOBS} SELECT job_id, j.document_id FROM j JOIN (SELECT document_id, max(job_id) FILTER (state = 'completed') AS h FROM j GROUP BY 1) m ON m.document_id = j.document_id WHERE h IS NULL OR job_id >= h")
def newer_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that are not older than what their document has."""
    j = jobs(spark, d)
    have = j.groupBy("document_id").agg(F.max(F.when(F.col("state") == "completed", F.col("job_id"))).alias("observation_epoch"))
    return E.newer_only(j, have, "document_id", "job_id").select("job_id", "document_id")


@R.add("SELECT event_id, '$.' || json_keys(props)[1] || ': ' || json_extract_string(props, '$.' || json_keys(props)[1]) AS flat FROM events")
def flattened_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON texts as lines of paths and values."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: "\n".join(flatten_json(json.loads(t))) if isinstance(t, str) else None)

    return table(spark, d, "events").select("event_id", run("props").alias("flat"))


_KIND = "CASE " + " ".join(f"WHEN e = '{e}' THEN '{k}'" for e, (_, k) in BY_EXTENSION.items()) + " END"


@R.add(f"SELECT kind, count(*) AS n FROM (SELECT {_KIND} AS kind FROM (SELECT lower(regexp_extract(file_name, '(\\.[^.]*)$', 1)) AS e FROM documents)) GROUP BY 1")
def format_kinds(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.formats import kind_column

    return table(spark, d, "documents").select(kind_column(F.col("file_name"), F.lit(b"").cast("binary")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@R.add("""WITH e AS (SELECT user_id AS document_id, count(*) AS issues FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1) SELECT document_id, issues FROM e WHERE issues < 27 OR (issues = 27 AND document_id > 20) ORDER BY issues DESC, document_id LIMIT 16""")
def issue_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of documents by their number of issues."""
    e = _errors(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("issues"))
    return I.keyset_page(e, [("issues", False), ("document_id", True)], [27, 20], 15)


@R.add()
def paged_groups(spark: SparkSession, d: str) -> DataFrame:
    """The pages on which the groups of a search are shown, at most one group of a document a page."""
    _, returned = _groups(spark, d)
    from ..operators.ranking import ranked

    placed = ranked(returned, [F.col("score").desc(), F.col("document_id"), F.col("content_id")], "position")
    return paged(placed, "document_id", 5, 1).select("content_id", "position", "page")


@R.add()
def box_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of the judged regions of each page lies in its upper half."""
    pages = table(spark, d, "eval_pages").select("corpus_id", "width", "height").where("width > 0 AND height > 0").groupBy("corpus_id").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    q = table(spark, d, "eval_queries").select("query_id", F.explode("qrels").alias("j")).select("query_id", "j.corpus_id", "j.bounding_boxes").distinct().join(pages, "corpus_id")
    scaled = F.transform("bounding_boxes", lambda b: F.array(b[0] / F.col("w"), b[1] / F.col("h"), b[2] / F.col("w"), b[3] / F.col("h")))
    half = F.array(F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 0.5)]))
    got = M.evidence_coverage(q.select("query_id", "corpus_id", scaled.alias("gold"), half.alias("predicted")), "gold", "predicted")
    return got.select("query_id", "corpus_id", "coverage.*")


@R.add()
def passages_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as blocks, sections and passages, with stable ids, offsets and the text for embedding."""
    kind = "doc_id bigint, id string, ordinal bigint, section_id string, section_offset bigint, display_text string, semantic_text string, semantic_eligible boolean"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                blocks, head = [], None
                for n, text in enumerate((r.text or "").split("\n\n"), 1):
                    if text.startswith("#"):
                        head = text.lstrip("# ").strip()
                    table_like = "\t" in text
                    blocks.append(S.Block(text, kind="structure", path=f"document/{'table' if table_like else 'paragraph'}[{n}]", heading=head, heading_path=(head,) if head else ()))
                _, made = S.passages_of(blocks, f"{r.doc_id:032x}", r.file_name or "", r.title or "")
                out += [(r.doc_id, p["id"], p["ordinal"], p["section_id"], p["section_offset"], p["display_text"], p["semantic_text"], p["semantic_eligible"]) for p in made]
            yield pd.DataFrame(out, columns=["doc_id", "id", "ordinal", "section_id", "section_offset", "display_text", "semantic_text", "semantic_eligible"])

    return table(spark, d, "documents").select("doc_id", "text", "file_name", "title").mapInPandas(run, kind)


@R.add()
def embedded_passages(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the passages that are worth one, by the stand-in embedder."""
    return passages(spark, d).where("semantic_eligible").select("id", hashing_embedder(64)("body_text").alias("vector"))


@R.add()
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Each document's job after all its events, by the step that the stream applies; the events of one document are folded in order."""
    kinds = {"signup": "created", "view": "lease", "error": "failed", "click": "completed", "purchase": "changed"}
    m = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    e = table(spark, d, "events").select(F.col("user_id").alias("document_id"), m[F.col("event_type")].alias("kind"), "ts", F.col("event_id").alias("seq"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        state, attempt, epoch = None, 0, 0
        for kind in part.sort_values(["ts", "seq"])["kind"]:
            state, attempt, epoch = E.step(state, attempt, epoch, kind)
        return pd.DataFrame({"document_id": [part["document_id"].iloc[0]], "state": [state], "attempt": [attempt], "epoch": [epoch]})

    return e.groupBy("document_id").applyInPandas(run, "document_id bigint, state string, attempt bigint, epoch bigint")


_THIRD = "k AS (SELECT job_id, job_id // 3 AS document_id, ts, state FROM j)"


@R.add(f"WITH {_JOBS} SELECT job_id, CASE WHEN state = 'running' AND document_id % 2 = 0 THEN 'queued' ELSE state END AS state FROM j")
def paused_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after one of two projects was paused: its running ones are queued again."""
    j = _project_jobs(spark, d, F.col("document_id"))
    projects = spark.createDataFrame([("p", "active"), ("q", "active")], "project_id string, state string")
    _, back, _ = store.set_paused(projects, j, spark.createDataFrame([], store.SCHEMAS["revisions"]), "p", True)
    return back.select(F.col("id").alias("job_id"), "state")


def _project_jobs(spark: SparkSession, d: str, document) -> DataFrame:
    return jobs(spark, d).select(F.col("job_id").alias("id"), F.when(F.col("document_id") % 2 == 0, "p").otherwise("q").alias("project_id"), document.alias("document_id"), F.lit("index").alias("kind"), "state", F.lit(1).cast("long").alias("expected_epoch"), F.lit(0).alias("attempt"), F.col("ts").cast("timestamp").alias("created_utc"),
                                 F.col("ts").cast("timestamp").alias("not_before"), F.lit(None).cast("timestamp").alias("lease_until"))


@R.add(f"WITH {_JOBS}, {_THIRD} SELECT document_id, 'index' AS kind FROM k GROUP BY 1 HAVING count(*) FILTER (state NOT IN ('completed', 'failed')) = 0 AND arg_max(state, (ts, job_id)) = 'failed'")
def retried_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs made to try again the documents, of three jobs each, whose last one failed."""
    j = _project_jobs(spark, d, F.floor(F.col("job_id") / 3).cast("bigint")).withColumn("project_id", F.lit("p")).withColumn("id", F.format_string("%012d", "id"))
    docs = j.select(F.col("document_id").alias("id")).distinct().withColumns({"project_id": F.lit("p"), "tombstoned": F.lit(False), "observation_epoch": F.lit(1).cast("long")})
    got = store.retry_failed(docs, j, "p", F.lit("2025-01-01").cast("timestamp"))
    return got.where("created_utc = TIMESTAMP '2025-01-01'").select("document_id", "kind")


@R.add(f"WITH {_FILES} SELECT id, CASE WHEN length(id) % 3 = 0 THEN id || '-new' ELSE id END AS path_key, CAST(CASE WHEN length(id) % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS observation_epoch FROM a")
def renamed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents after a third of the files got other names: ids stay."""
    known, _ = _known(spark, d)
    new = F.concat("path_key", F.lit("-new"))
    moved = known.where("length(id) % 3 = 0").select("project_id", F.col("path_key").alias("old_key"), new.alias("path"), new.alias("path_key"), "file_name", "extension")
    return store.rename(known, moved).select("id", "path_key", "observation_epoch")


@R.add("""WITH l AS (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS u FROM events), d AS (SELECT user_id, sum(CASE WHEN event_type <> 'view' THEN epoch_us(u) - epoch_us(ts) END) AS s FROM l GROUP BY 1 HAVING count(*) FILTER (event_type = 'click') > 0)
SELECT user_id % 5 AS project, count(*) AS jobs, round(avg(coalesce(s, 0)) / 1e6, 3) AS average_seconds FROM d GROUP BY 1""")
def processing_times(spark: SparkSession, d: str) -> DataFrame:
    """Mean time that jobs were worked on, without their waiting, for each project."""
    e = table(spark, d, "events").withColumn("project", F.col("user_id") % 5)
    return I.processing_times(e, ["project"], "user_id", "event_type", "ts", ("view",), "click").withColumn("average_seconds", F.round("average_seconds", 3))
