"""From files to an index: list, compare, extract, cut into passages, embed, commit."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import name_key
from .operators.inventory import renames
from .operators.sections import Block, deterministic_id, passages_of
from .runtime import ship
from .service import text_index
from .sources.extract import extract_files, read_files
from .sources.formats import BY_EXTENSION
from .store import PREPARATION, SCHEMAS, Store, activate, observe, reconcile, rename, tombstone


def listing(spark: SparkSession, project: str, folder: str) -> DataFrame:
    """Files under a folder that can be indexed, without reading them: hidden ones and links' targets outside are not listed."""
    files = read_files(spark, folder).select("path", "modificationTime", "length")
    path = F.regexp_replace("path", "^file:/*", "/")
    low = F.lower(path)
    known = F.lit(False)
    for e in BY_EXTENSION:
        known = known | low.endswith(e)
    ext = F.when(low.endswith(".tar.gz"), ".tar.gz").otherwise(F.regexp_extract(low, r"(\.[^./\\]+)$", 1))
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return files.where(known & ~name.startswith(".")).select(F.sha2(F.concat_ws("|", F.lit(project), path), 256).alias("id"), F.lit(project).alias("project_id"), F.lit(folder).alias("folder_id"), path.alias("path"), F.upper(path).alias("path_key"),
                                                             name.alias("file_name"), ext.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_utc"))


def prepare(extracted: DataFrame) -> DataFrame:
    """(document_id, revision_id, nodes, sections, passages) of extracted files (document_id, project_id, path, file_name, sha256, nodes)."""
    def rows(part: pd.DataFrame) -> Iterator[tuple]:
        for r in part.itertuples(index=False):
            revision = deterministic_id(r.document_id, "revision", f"{r.sha256}|{PREPARATION}")
            base = {"project_id": r.project_id, "document_id": r.document_id, "revision_id": revision}
            nodes, sections, passages = [], [], []
            ids: dict[int, str] = {}
            paths: dict[int, str] = {}
            seen: dict[tuple, int] = {}
            for n in r.nodes:
                if n["parent"] is None or n["parent"] != n["parent"]:
                    paths[n["node"]] = "root"
                    parent = None
                else:
                    sibling = f"{name_key(n['relationship'])}\x1f{name_key(n['name'])}"
                    k = seen[n["parent"], sibling] = seen.get((n["parent"], sibling), -1) + 1
                    paths[n["node"]] = f"{paths[n['parent']]}/{sibling}\x1f{k}"
                    parent = ids[n["parent"]]
                content = ids[n["node"]] = deterministic_id(r.document_id, "content", paths[n["node"]])
                nodes.append(base | {"id": content, "parent_id": parent, "ordinal": n["ordinal"], "name": n["name"], "mime_type": n["media_type"], "relationship": n["relationship"], "depth": n["depth"], "status": n["status"]})
                blocks = [Block(**{k: (tuple(v) if k == "heading_path" and v is not None else None if isinstance(v, float) and v != v else v) for k, v in b.items()}) for b in n["blocks"]]
                subject = next((ln[8:].strip() for b in blocks if b.kind == "email_part" for ln in b.text.split("\n") if ln.lower().startswith("subject:") and ln[8:].strip()), "")
                stem = posixpath.splitext(n["name"])[0]
                title = n["title"] or ""
                if name_key(title) in {name_key(x) for x in (n["name"], stem, r.file_name, posixpath.splitext(r.file_name)[0])}:
                    title = ""
                s, p = passages_of(blocks, content, r.file_name, title, subject, n["name"])
                where = {b.key: b for b in reversed(blocks)}
                sections += [base | {k: x.get(k) for k in ("id", "content_id", "ordinal", "display_text", "heading", "heading_path")} | {"kind": x["section_kind"], "location": _place(next(iter(where.values()), None))} for x in s]
                for x in p:
                    block = next((b for b in blocks if b.heading == x["heading"] and b.text[:40] and b.text[:40] in x["display_text"]), blocks[0] if blocks else None)
                    passages.append(base | {k: x[k] for k in ("id", "content_id", "ordinal", "display_text", "semantic_text", "body_text", "heading", "section_id", "section_offset", "semantic_eligible", "extraction_method", "ocr_confidence")}
                                    | {"title": title, "file_name": r.file_name, "path": r.path, "content_name": n["name"], "email_subject": subject or None, "location": _place(block)})
            yield r.document_id, revision, nodes, sections, passages

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(list(rows(part)), columns=["document_id", "revision_id", "nodes", "sections", "passages"])

    kind = "document_id string, revision_id string, " + ", ".join(f"{name} array<{SCHEMAS[t].simpleString()}>" for name, t in (("nodes", "content_nodes"), ("sections", "sections"), ("passages", "passages")))
    return extracted.select("document_id", "project_id", "path", "file_name", "sha256", "nodes").mapInPandas(run, kind)


def _place(b: Block | None) -> dict | None:
    if b is None:
        return None
    return {"kind": b.kind, "page": b.page, "sheet": b.sheet, "cell_range": b.cell_range, "slide": b.slide, "structure_path": b.path, "email_part": b.email_part, "image_frame": b.frame, "region": None, "layout_warning": b.warning}


def moves(own: DataFrame, seen: DataFrame, known: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """(project_id, old_key, path, path_key, file_name, extension) of files that were renamed: known documents that are gone and new files with their
    size, time and content, where these leave no choice on either side. Only files of such a size and time are read."""
    gone = own.join(seen.select("project_id", "path_key"), ["project_id", "path_key"], "left_anti").where("sha256 IS NOT NULL")
    new = seen.join(known.where("NOT tombstoned").select("project_id", "path_key"), ["project_id", "path_key"], "left_anti").join(gone.select("size", "modified_utc").distinct(), ["size", "modified_utc"], "left_semi")
    kept = new.persist()
    try:
        if not kept.limit(1).count():
            return spark.createDataFrame([], "project_id string, old_key string, path string, path_key string, file_name string, extension string")
        files = read_files(spark, folder).withColumn("path", F.regexp_replace("path", "^file:/*", "/")).join(kept.select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("sha256"))
        hashed = kept.join(files, "path")
        pairs = renames(gone.select("sha256", F.col("path_key").alias("k")), hashed.select("sha256", F.col("path_key").alias("k")), "sha256", "k").select(F.col("old").alias("old_key"), F.col("new").alias("path_key"))
        return hashed.join(pairs, "path_key").select("project_id", "old_key", "path", "path_key", "file_name", "extension")
    finally:
        kept.unpersist()


def index_folder(store: Store, project: str, folder: str, embed: Callable[[Column], Column] | None = None, policy: str = "none", force: bool = False) -> dict[str, int]:
    """Brings a project's index in line with a folder; returns how many documents were indexed, were unchanged and were deleted, and, where there were
    any, how many were renamed, changed while they were read, or could not be reached.

    The listing is compared with the known documents by size and time before anything is read; only changed files are opened, in parallel,
    and one commit replaces their rows. A file whose content is what was indexed, by the same preparation, keeps its revision. A new file with
    the content of one that is gone is the same document under another name, and keeps its id. A file that has changed while it was read is
    left as it was, to be read again. Of a folder that cannot be listed, or is empty though documents of it are known, nothing is deleted:
    its documents are marked as not available."""
    ship(store.spark)
    work = f"{store.root.rstrip('/')}/_work/{uuid4().hex}"
    try:
        return _index(store, project, folder, embed, policy, force, work)
    finally:
        store.files.delete(work)


def _index(store: Store, project: str, folder: str, embed: Callable[[Column], Column] | None, policy: str, force: bool, work: str) -> dict[str, int]:
    spark = store.spark

    def keep(df: DataFrame) -> DataFrame:
        """df as a table in the store's folder for the time of the run: used several times, its plan is not carried into later ones."""
        path = f"{work}/{uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    at = store.manifest()
    known = store.read("documents", at)
    own = known.where((F.col("project_id") == project) & (F.col("folder_id") == folder) & ~F.col("tombstoned"))
    try:
        seen = keep(listing(spark, project, folder))
        reached = seen.limit(1).count() > 0 or not own.limit(1).count()
    except AnalysisException:
        reached = False
    if not reached:
        lost = own.count()
        if own.where("available").limit(1).count():
            away = (F.col("project_id") == project) & (F.col("folder_id") == folder) & ~F.col("tombstoned")
            store.commit({"documents": known.withColumn("available", F.col("available") & ~away)}, expected=at["generation"])
        return {"indexed": 0, "unchanged": 0, "deleted": 0, "unavailable": lost}
    moved = keep(moves(own, seen, known, spark, folder))
    docs, changed = observe(rename(known, moved), seen, force)
    changed = changed.unionByName(docs.join(moved.select("project_id", "path_key"), ["project_id", "path_key"], "left_semi").select("id")).distinct()
    gone = reconcile(docs.where(F.col("project_id") == project), seen, spark.createDataFrame([(folder,)], "folder_id string"))
    docs = keep(tombstone(docs, gone))
    todo = keep(docs.join(changed, "id", "left_semi").select(F.col("id").alias("document_id"), "project_id", "path", "file_name", F.col("sha256").alias("_old"), "active_revision_id"))
    n = todo.count()
    result = {"indexed": 0, "unchanged": seen.count() - n, "deleted": gone.count()}
    if not n and not result["deleted"]:
        return result
    files = read_files(spark, folder).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    opened = keep(extract_files(files.join(todo.select("path"), "path", "left_semi")).join(todo, "path"))
    # files that are no longer what was listed are read another time
    still = listing(spark, project, folder).join(seen.select("path", "size", "modified_utc"), ["path", "size", "modified_utc"], "left_semi").select("path")
    steady = keep(opened.join(still, "path", "left_semi"))
    unsteady = opened.count() - steady.count()
    renamed = moved.select("path")
    fresh = keep(steady.join(renamed.withColumn("_moved", F.lit(True)), "path", "left").where(F.lit(force) | F.coalesce("_moved", F.lit(False)) | ~(F.col("sha256").eqNullSafe(F.col("_old")) & F.col("active_revision_id").isNotNull())))
    if unsteady:
        result["changed_meanwhile"] = unsteady
        late = todo.join(steady.select("document_id"), "document_id", "left_anti").select(F.col("document_id").alias("id"))
        before = known.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in ("size", "modified_utc")]).join(late, "id", "left_semi").withColumn("_late", F.lit(True))
        docs = docs.join(late.withColumn("_l", F.lit(True)), "id", "left").join(before, "id", "left")
        docs = docs.withColumns({c: F.when(F.col("_l"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("size", "modified_utc")}).drop("_l", "_late", "_size", "_modified_utc")
    if n_moved := moved.count():
        result["renamed"] = n_moved
    made = keep(prepare(fresh))
    touched = made.select("document_id")
    part = lambda c: made.select(F.explode(c).alias("x")).select("x.*")
    now = F.current_timestamp()
    revisions = made.join(fresh.select("document_id", "project_id", "sha256"), "document_id").select(F.col("revision_id").alias("id"), "project_id", "document_id", "sha256", F.lit("staging").alias("status"), F.lit(policy).alias("embedding_policy"), F.lit(PREPARATION).alias("preparation_version"), now.alias("activated_utc"))
    errors = fresh.select("document_id", "project_id", F.explode("errors").alias("e")).select(F.sha2(F.concat_ws("|", "document_id", "e.code", "e.component"), 256).alias("id"), "project_id", "document_id", "e.code", "e.component", "e.message", "e.retryable", now.alias("created_utc"))
    active = made.select(F.col("document_id").alias("id"), F.col("revision_id").alias("_r")).join(fresh.select(F.col("document_id").alias("id"), F.col("sha256").alias("_s")), "id")
    docs = docs.join(active, "id", "left").withColumn("active_revision_id", F.coalesce("_r", "active_revision_id")).withColumn("sha256", F.coalesce("_s", "sha256")).drop("_r", "_s")
    passages = part("passages")
    index = text_index(passages)
    changes = {**index, "documents": docs, "revisions": activate(store.read("revisions", at), revisions), "content_nodes": part("nodes"), "sections": part("sections"), "passages": passages, "errors": errors}
    if embed is not None:
        changes["embeddings"] = passages.where("semantic_eligible").select(F.col("id").alias("passage_id"), "project_id", "document_id", "revision_id", embed(F.col("semantic_text")).alias("vector"), F.lit(policy).alias("policy_key"))
    result["indexed"] = made.count()
    store.commit(changes, touched.unionByName(gone.select(F.col("id").alias("document_id"))), expected=at["generation"])
    return result

