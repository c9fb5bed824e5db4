"""The index on disk: versioned Parquet tables behind a manifest, and the state changes of documents and jobs.

A commit writes the new files of the tables it changes under a new generation and then a manifest of the next number, so a reader that has read
a manifest sees one generation of all tables; of two writers only one can make the next manifest. Tables of documents' rows lie in
buckets of documents: a commit writes each of them once, with the rows of the buckets it touches, and carries the others over by name.

The text index is a table of postings in segments, one a commit, each laid out by term, so that a search reads the few folders of its terms.
Rows of replaced documents are left behind in older segments and not read: ``lengths``, which is replaced with its documents, says in
which segment an indexed row lies. :meth:`Store.compact` makes one segment of all."""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import name_key
from .operators.clauses import RequestError
from .operators.inventory import fail_job, latest_by, merge_open_jobs, missing, newest

#: Version of extraction and chunking; passages of another version are made again.
PREPARATION = "layout-1/spans-1/context-1"
BUCKETS = 64

_S, _L, _I, _B, _D, _T = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType()
REGION = T.StructType([T.StructField(n, _D) for n in ("x", "y", "width", "height")])
LOCATION = T.StructType([T.StructField("kind", _S), T.StructField("page", _I), T.StructField("sheet", _S), T.StructField("cell_range", _S), T.StructField("slide", _I), T.StructField("structure_path", _S),
                         T.StructField("email_part", _S), T.StructField("image_frame", _I), T.StructField("region", REGION), T.StructField("layout_warning", _S)])


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


SCHEMAS: dict[str, T.StructType] = {
    "projects": _schema(project_id=_S, name=_S, name_key=_S, state=_S, search_generation=_L, created_utc=_T, updated_utc=_T),
    "project_folders": _schema(id=_S, project_id=_S, path=_S, path_key=_S),
    "documents": _schema(id=_S, project_id=_S, folder_id=_S, path=_S, path_key=_S, file_name=_S, extension=_S, size=_L, modified_utc=_T, sha256=_S, observation_epoch=_L, tombstoned=_B, available=_B, active_revision_id=_S),
    "revisions": _schema(id=_S, project_id=_S, document_id=_S, sha256=_S, status=_S, embedding_policy=_S, preparation_version=_S, activated_utc=_T),
    "content_nodes": _schema(id=_S, project_id=_S, document_id=_S, revision_id=_S, parent_id=_S, ordinal=_I, name=_S, mime_type=_S, relationship=_S, depth=_I, status=_S),
    "sections": _schema(id=_S, project_id=_S, document_id=_S, revision_id=_S, content_id=_S, ordinal=_I, display_text=_S, heading=_S, heading_path=T.ArrayType(_S), kind=_S, location=LOCATION),
    "passages": _schema(id=_S, project_id=_S, document_id=_S, revision_id=_S, content_id=_S, ordinal=_I, display_text=_S, semantic_text=_S, body_text=_S, title=_S, heading=_S, file_name=_S, path=_S, content_name=_S, email_subject=_S,
                        location=LOCATION, extraction_method=_S, ocr_confidence=_D, section_id=_S, section_offset=_I, semantic_eligible=_B),
    "embeddings": _schema(passage_id=_S, project_id=_S, document_id=_S, revision_id=_S, vector=T.ArrayType(T.FloatType()), policy_key=_S),
    "index_jobs": _schema(id=_S, project_id=_S, document_id=_S, kind=_S, state=_S, expected_epoch=_L, attempt=_I, created_utc=_T, not_before=_T, lease_until=_T),
    "errors": _schema(id=_S, project_id=_S, document_id=_S, code=_S, component=_S, message=_S, retryable=_B, created_utc=_T),
    "acknowledgements": _schema(project_id=_S, signature=_S, created_utc=_T),
    "lifecycles": _schema(project_id=_S, signature=_S, first_seen=_T, last_seen=_T, occurrences=_L),
    "exclusions": _schema(project_id=_S, path_key=_S, created_utc=_T),
    "postings": _schema(scope=_S, id=_S, field=_S, term=_S, positions=T.ArrayType(_I), segment=_L),
    "lengths": _schema(scope=_S, id=_S, project_id=_S, document_id=_S, revision_id=_S, length=_L, segment=_L),
}
#: Tables whose rows belong to a document and which a commit of documents replaces bucket by bucket.
OF_DOCUMENT = ("content_nodes", "sections", "passages", "embeddings", "errors", "lengths")
#: Tables of which every commit adds a segment.
SEGMENTS = ("postings",)


#: Letters of a term that decide its folder in the text index, and the number of folders.
HEAD, HEADS = 2, 64
#: Parts of a folder of terms that are written apart, and postings of a block that is shuffled as one.
PARTS, PACKED = 4, 500_000


def head(term: str) -> int:
    """The folder of a term or of all that begin with a prefix of HEAD letters or more."""
    return crc32(term[:HEAD].encode()) % HEADS


def head_column(term: Column) -> Column:
    return (F.crc32(F.substring(term, 1, HEAD).cast("binary")) % HEADS).cast("int")


def bucket(document: Column) -> Column:
    return F.pmod(F.xxhash64(document), F.lit(BUCKETS)).cast("int")


def shaped(table: str, df: DataFrame) -> DataFrame:
    """df with the columns of a table; those it lacks are null."""
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])


def by_term(postings: DataFrame, parts: int) -> DataFrame:
    """Postings with their ``head``, shuffled and sorted by it and the term. They are shuffled in compressed columns, of about PACKED rows of a task at a
    time, as they would be several times larger row by row."""
    rows = postings.withColumn("head", head_column(F.col("term"))).withColumn("part", (F.col("head") * parts + F.pmod(F.xxhash64("term"), F.lit(parts))).cast("int"))
    size = PACKED

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).sort_by([("part", "ascending"), ("term", "ascending"), ("id", "ascending")]).combine_chunks()
            part = t.column("part").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            t, out = t.drop_columns(["part"]), []
            for a, b in zip(starts, starts[1:]):
                one = t.slice(a, b - a)
                for k, f in enumerate(one.schema):
                    if pa.types.is_string(f.type) and f.name != "id":
                        one = one.set_column(k, f.name, one.column(k).combine_chunks().dictionary_encode())
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(one)
                out.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(part[starts[:-1]], pa.int32()), pa.array(out, pa.binary())], ["part", "block"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= size:
                yield blocks(held)
                held, n = [], 0
        if n:
            yield blocks(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                t = pa.ipc.open_stream(block.as_buffer()).read_all()
                t = pa.table([c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for c in t.columns], names=t.schema.names)
                yield from t.combine_chunks().to_batches()

    packed = rows.mapInArrow(pack, "part int, block binary").repartition("part")
    return packed.mapInArrow(unpack, T.StructType([*SCHEMAS["postings"], T.StructField("head", _I)])).sortWithinPartitions("head", "term", "id")


class Files:
    """The few operations on a folder that all executors share, by the file system of its address."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a file with its whole text, or returns False where there is one of that name. One of several writers succeeds."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self.path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if not self.local:
                return bool(self.fs.rename(self.path(part), self.path(name)))
            try:
                os.link(self.path(part).toUri().getPath(), self.path(name).toUri().getPath())
                return True
            except FileExistsError:
                return False
        finally:
            self.fs.delete(self.path(part), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Store:
    """A folder with the index's tables. Readers and the one writer meet in the manifest only."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.files = Files(self.spark, self.root)

    def _at(self, *parts: str) -> str:
        return "/".join((self.root.rstrip("/"), *parts))

    def manifest(self) -> dict:
        """{"generation": n, "tables": {name: {bucket or segment: path}}}; generation 0 for a new store."""
        numbers = [n for n in self.files.names(self._at("manifests")) if n.endswith(".json")]
        return json.loads(self.files.text(self._at("manifests", max(numbers)))) if numbers else {"generation": 0, "tables": {}}

    @property
    def generation(self) -> int:
        return self.manifest()["generation"]

    def read(self, table: str, at: dict | None = None) -> DataFrame:
        """A table as one manifest has it; pass the same manifest to read several tables of one generation."""
        return self._open(table, sorted((at or self.manifest())["tables"].get(table, {}).values()))

    def _open(self, table: str, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        reader = self.spark.read.schema(SCHEMAS[table])
        if table in SEGMENTS:
            reader = reader.option("basePath", self._at(table))
        return reader.parquet(*[self._at(p) for p in paths]).select(*SCHEMAS[table].names)

    def postings(self, terms: Sequence[str], prefixes: Sequence[str] = (), at: dict | None = None) -> DataFrame:
        """The postings of some terms and of all that begin with one of some prefixes: only the folders of their first letters are read."""
        where = F.col("term").isin(*terms) if terms else F.lit(False)
        for p in prefixes:
            where = where | F.col("term").startswith(p)
        if any(len(p) < HEAD for p in prefixes):
            return self.read("postings", at).where(where)
        return self.postings_of({head(t) for t in (*terms, *prefixes)}, at).where(where)

    def postings_of(self, heads: Iterable[int], at: dict | None = None) -> DataFrame:
        """The postings in some folders, of HEADS that there are."""
        paths = sorted((at or self.manifest())["tables"].get("postings", {}).values())
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS["postings"])
        rows = self.spark.read.schema(T.StructType([*SCHEMAS["postings"], T.StructField("head", _I)])).option("basePath", self._at("postings")).parquet(*[self._at(p) for p in paths])
        return rows.where(F.col("head").isin(*sorted(heads))).select(*SCHEMAS["postings"].names)

    def _write(self, table: str, df: DataFrame, generation: int, by: str | None = None) -> str:
        path = f"{table}/{'part=' if table in SEGMENTS else ''}g{generation:08d}-{uuid.uuid4().hex[:8]}"
        writer = df.write
        if table in SEGMENTS:  # sorted by term and id, which delta encodings make small
            writer = writer.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        (writer.partitionBy(by) if by else writer).parquet(self._at(path))
        return path

    def commit(self, changes: Mapping[str, DataFrame], documents: DataFrame | None = None, expected: int | None = None) -> int:
        """Replaces tables, or of the tables in OF_DOCUMENT the rows of ``documents``, in one step; returns the new generation.

        ``expected`` is the generation the changes were made from: if another commit came first, nothing changes and a conflict is raised.
        Each table is written once, and of OF_DOCUMENT only the buckets that hold one of the documents are read."""
        before = self.manifest()
        if expected is not None and before["generation"] != expected:
            raise RequestError("generation_conflict", f"{before['generation']} is not {expected}")
        generation = before["generation"] + 1
        tables = {t: dict(p) for t, p in before["tables"].items()}
        touched: list[str] = []
        if documents is not None:
            documents = documents.select("document_id").distinct()
            touched = [str(r["b"]) for r in documents.select(bucket(F.col("document_id")).alias("b")).distinct().collect()]  # BUCKETS at most
        for table, new in changes.items():
            new = shaped(table, new)
            if table in SEGMENTS:
                rows = new.withColumn("segment", F.lit(generation).cast("long")).withColumn("head", head_column(F.col("term")))
                tables.setdefault(table, {})[f"g{generation:08d}"] = self._write(table, by_term(shaped("postings", rows), PARTS), generation, "head")
            elif table in OF_DOCUMENT and documents is not None:
                held = tables.setdefault(table, {})
                old = self._open(table, [held.pop(b) for b in touched if b in held])
                if table == "lengths":
                    new = new.withColumn("segment", F.lit(generation).cast("long"))
                rows = old.join(documents, "document_id", "left_anti").select(*SCHEMAS[table].names).unionByName(new).withColumn("_bucket", bucket(F.col("document_id")))
                path = self._write(table, rows.repartition("_bucket"), generation, "_bucket")
                held |= {n.removeprefix("_bucket="): f"{path}/{n}" for n in self.files.names(self._at(path)) if n.startswith("_bucket=")}
            else:
                tables[table] = {"all": self._write(table, new, generation)}
        if not self.files.create(self._at("manifests", f"{generation:012d}.json"), json.dumps({"generation": generation, "tables": tables})):
            raise RequestError("generation_conflict", "another commit came first")
        return generation

    def compact(self) -> int:
        """One segment of all postings in place of several, without those of rows that are gone; returns the new generation."""
        at = self.manifest()
        lengths = self.read("lengths", at)
        live = self.read("postings", at).join(lengths.select("scope", "id", "segment"), ["scope", "id", "segment"], "left_semi")
        generation = at["generation"] + 1
        rows = live.withColumn("segment", F.lit(generation).cast("long")).withColumn("head", head_column(F.col("term")))
        path = self._write("postings", by_term(shaped("postings", rows), PARTS), generation, "head")
        moved = self._write("lengths", lengths.withColumn("segment", F.lit(generation).cast("long")).withColumn("_bucket", bucket(F.col("document_id"))).repartition("_bucket"), generation, "_bucket")
        tables = at["tables"] | {"postings": {f"g{generation:08d}": path}, "lengths": {n.removeprefix("_bucket="): f"{moved}/{n}" for n in self.files.names(self._at(moved)) if n.startswith("_bucket=")}}
        if not self.files.create(self._at("manifests", f"{generation:012d}.json"), json.dumps({"generation": generation, "tables": tables})):
            raise RequestError("generation_conflict", "another commit came first")
        return generation

    def active_passages(self, project: str | None = None, at: dict | None = None) -> DataFrame:
        """Passages of the active revision of documents that are there: what every search reads."""
        at = at or self.manifest()
        docs = self.read("documents", at).where("NOT tombstoned AND active_revision_id IS NOT NULL")
        if project:
            docs = docs.where(F.col("project_id") == project)
        live = docs.join(self.read("exclusions", at).select("project_id", "path_key"), ["project_id", "path_key"], "left_anti").select(F.col("id").alias("document_id"), F.col("active_revision_id").alias("revision_id"))
        return self.read("passages", at).join(live, ["document_id", "revision_id"], "left_semi")

    def vacuum(self) -> int:
        """Deletes the files that the newest manifest no longer names, and older manifests; returns how many folders went."""
        at = self.manifest()
        named = {p for t in at["tables"].values() for p in t.values()}
        inside = {"/".join(p.split("/")[:2]) for p in named}
        gone = 0
        for table in SCHEMAS:
            for name in self.files.names(self._at(table)):
                path = f"{table}/{name}"
                parts = [path] if path not in inside else [f"{path}/{x}" for x in self.files.names(self._at(path)) if x.startswith("_bucket=") and f"{path}/{x}" not in named]
                for part in parts:
                    self.files.delete(self._at(part))
                gone += len(parts)
        for name in self.files.names(self._at("manifests")):
            if name != f"{at['generation']:012d}.json":
                self.files.delete(self._at("manifests", name))
        return gone


# State changes, as functions of tables


def observe(documents: DataFrame, seen: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, changed ids) after files were observed: new ones are added, changed ones get a higher epoch, vanished names come back.

    seen: id, project_id, folder_id, path, path_key, file_name, extension, size, modified_utc. Of several observations of a path the latest
    counts. A file has changed when its size or time differs, it was deleted, or ``force``."""
    s = latest_by(seen, ["project_id", "path_key"], [F.col("modified_utc"), F.col("size"), F.col("id")])
    s = s.select("project_id", "path_key", *[F.col(c).alias(f"_{c}") for c in ("id", "folder_id", "path", "file_name", "extension", "size", "modified_utc")])
    j = documents.join(s, ["project_id", "path_key"], "full")
    changed = F.col("_id").isNotNull() & (F.col("id").isNull() | F.lit(force) | F.coalesce(F.col("tombstoned"), F.lit(False)) | ~F.col("size").eqNullSafe(F.col("_size")) | ~F.col("modified_utc").eqNullSafe(F.col("_modified_utc")))
    take = lambda c: F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    out = j.select(F.coalesce("id", "_id").alias("id"), "project_id", take("folder_id"), take("path"), "path_key", take("file_name"), take("extension"), take("size"), take("modified_utc"), "sha256",
                   (F.coalesce("observation_epoch", F.lit(0)) + changed.cast("long")).alias("observation_epoch"), (F.coalesce("tombstoned", F.lit(False)) & F.col("_id").isNull()).alias("tombstoned"), F.lit(True).alias("available"), "active_revision_id", changed.alias("_changed"))
    return out.drop("_changed"), out.where("_changed").select("id")


def tombstone(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents marked as deleted, with a higher epoch so that work on them under way is dropped."""
    j = documents.join(gone.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    dead = F.coalesce("_gone", F.lit(False)) & ~F.col("tombstoned")
    return j.withColumn("observation_epoch", F.col("observation_epoch") + dead.cast("long")).withColumn("active_revision_id", F.when(~dead, F.col("active_revision_id"))).withColumn("tombstoned", F.col("tombstoned") | dead).drop("_gone").select(*documents.columns)


def reconcile(documents: DataFrame, listing: DataFrame, folders_available: DataFrame) -> DataFrame:
    """Ids of the documents that a whole listing no longer has; of folders that could not be listed nothing is taken for deleted."""
    known = documents.where("NOT tombstoned").join(folders_available.select("folder_id").distinct(), "folder_id", "left_semi")
    return missing(known, listing, ["project_id", "path_key"]).select("id")


def request_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """jobs with at most one open job a document: requests (id, project_id, document_id, kind, expected_epoch, created_utc) join an open job
    or open one; re-indexing outweighs indexing."""
    ready = F.col("state").isin("queued", "retry_wait", "running")
    merged = merge_open_jobs(requests, "document_id", "kind", "created_utc").join(requests.groupBy("document_id").agg(F.max("expected_epoch").alias("_e"), F.min("id").alias("_id"), F.first("project_id").alias("_p")), "document_id")
    m = merged.select("document_id", F.col("kind").alias("_k"), F.col("created_utc").alias("_c"), "_e", "_id", "_p")
    have = jobs.where(ready).select("document_id").distinct()
    old = jobs.join(m, "document_id", "left")
    asked = ready & F.col("_k").isNotNull()
    old = old.withColumn("kind", F.when(asked & (F.col("_k") == "reindex"), "reindex").otherwise(F.col("kind"))).withColumn("expected_epoch", F.when(asked, F.greatest("expected_epoch", "_e")).otherwise(F.col("expected_epoch"))).select(*jobs.columns)
    new = m.join(have, "document_id", "left_anti").select(F.col("_id").alias("id"), F.col("_p").alias("project_id"), "document_id", F.col("_k").alias("kind"), F.lit("queued").alias("state"), F.col("_e").alias("expected_epoch"), F.lit(0).alias("attempt"), F.col("_c").alias("created_utc"), F.col("_c").alias("not_before"), F.lit(None).cast("timestamp").alias("lease_until"))
    return old.unionByName(new.select(*jobs.columns))


def lease(jobs: DataFrame, now: Column, n: int, minutes: int = 20) -> DataFrame:
    """jobs with the n oldest ready ones running under a lease; expired leases are ready again."""
    ready = (F.col("state").isin("queued", "retry_wait") & (F.coalesce("not_before", now) <= now)) | ((F.col("state") == "running") & (F.col("lease_until") < now))
    head = jobs.where(ready).select("id", "created_utc").orderBy("created_utc", "id").limit(n).select("id", F.lit(True).alias("_head"))
    j = jobs.join(F.broadcast(head), "id", "left")  # n rows
    got = F.coalesce("_head", F.lit(False))
    return j.withColumn("state", F.when(got, "running").otherwise(F.col("state"))).withColumn("attempt", F.col("attempt") + got.cast("int")).withColumn("lease_until", F.when(got, now + F.expr(f"INTERVAL {int(minutes)} MINUTES")).otherwise(F.col("lease_until"))).drop("_head").select(*jobs.columns)


def fail(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """jobs after failures (id, retryable): waiting for another try, or failed."""
    j = jobs.join(failures.select("id", F.col("retryable").alias("_r")), "id", "left")
    state, at = fail_job(F.col("state"), F.col("attempt"), F.coalesce("_r", F.lit(False)), now)
    hit = F.col("_r").isNotNull()
    return j.withColumn("_s", F.when(hit, state).otherwise(F.col("state"))).withColumn("not_before", F.when(hit, at).otherwise(F.col("not_before"))).withColumn("state", F.col("_s")).drop("_r", "_s").select(*jobs.columns)


def complete(jobs: DataFrame, done: DataFrame, documents: DataFrame) -> DataFrame:
    """jobs after work on them ended (id, epoch): completed, or queued again if the document has been observed anew since."""
    epochs = documents.select(F.col("id").alias("document_id"), F.col("observation_epoch").alias("_now"))
    j = jobs.join(done.select("id", F.col("epoch").alias("_e")), "id", "left").join(epochs, "document_id", "left")
    j = j.withColumn("_hit", F.col("_e").isNotNull() & (F.col("state") == "running"))
    hit, stale = F.col("_hit"), F.coalesce(F.col("_now") > F.col("_e"), F.lit(False))
    return j.withColumn("state", F.when(hit & stale, "queued").when(hit, "completed").otherwise(F.col("state"))).withColumn("expected_epoch", F.when(hit & stale, F.col("_now")).otherwise(F.col("expected_epoch"))).select(*jobs.columns)


def recover(jobs: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, revisions) after a crash: running jobs are queued again, revisions that were never activated go."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "queued").otherwise(F.col("state"))).withColumn("lease_until", F.lit(None).cast("timestamp")), revisions.where("status <> 'staging'")


def activate(revisions: DataFrame, new: DataFrame) -> DataFrame:
    """revisions with the new ones active and those they replace superseded."""
    docs = new.select("document_id").distinct().withColumn("_n", F.lit(True))
    old = revisions.join(new.select("id"), "id", "left_anti").join(docs, "document_id", "left").withColumn("status", F.when(F.col("_n") & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))).select(*revisions.columns)
    return old.unionByName(new.withColumn("status", F.lit("active")).select(*revisions.columns))


def prune_jobs(jobs: DataFrame) -> DataFrame:
    """The newest ended job of each document, and all open ones."""
    ended = F.col("state").isin("completed", "failed", "superseded")
    return jobs.where(~ended).unionByName(newest(jobs.where(ended), ["document_id"], [F.col("created_utc").desc(), F.col("id").desc()], 1))


def needs_refresh(passages: DataFrame, embeddings: DataFrame, policy: str, dimension: int) -> DataFrame:
    """Documents with a passage worth a vector that has none of the policy."""
    good = embeddings.where((F.col("policy_key") == policy) & (F.size("vector") == dimension)).select("passage_id", "revision_id")
    return passages.where("semantic_eligible").select(F.col("id").alias("passage_id"), "revision_id", "document_id").join(good, ["passage_id", "revision_id"], "left_anti").select("document_id").distinct()


def bind_errors(errors: DataFrame, nodes: DataFrame) -> DataFrame:
    """errors with ``content_id``: of the nodes whose key begins the error's component the one with the longest, else the only node of that name.

    nodes: document_id, content_id, key, name. Prefixes are cut from each error's component at ``/``, so the join is on equality."""
    e = errors.withColumn("_e", F.monotonically_increasing_id())
    parts = F.split(F.coalesce("component", F.lit("")), "/")
    prefixes = e.select("_e", "document_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("key"))
    by_key = prefixes.join(nodes.select("document_id", "key", F.col("content_id").alias("_c")), ["document_id", "key"]).groupBy("_e").agg(F.max_by("_c", F.length("key")).alias("_by_key"))
    single = nodes.groupBy("document_id", F.col("name").alias("component")).agg(F.min("content_id").alias("_by_name"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return e.join(by_key, "_e", "left").join(single, ["document_id", "component"], "left").withColumn("content_id", F.coalesce("_by_key", "_by_name")).drop("_e", "_by_key", "_by_name")


def validate_folders(paths: Sequence[str]) -> list[str]:
    """Folders of a project, normalised; one inside another is refused."""
    clean = [os.path.normpath(p).replace("\\", "/") for p in paths]
    for i, a in enumerate(clean):
        for j, b in enumerate(clean):
            if i != j and (a == b or a.startswith(b.rstrip("/") + "/")):
                raise RequestError("nested_folder", f"{a} lies in {b}")
    return clean


# Projects, their jobs and files


def create_project(projects: DataFrame, folders: DataFrame, project: str, name: str, paths: Sequence[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(projects, folders) with a new project; a name that another has, whatever its case, and nested folders are refused."""
    if projects.where((F.col("name_key") == name_key(name)) | (F.col("project_id") == project)).limit(1).count():
        raise RequestError("project_exists", name)
    new = projects.sparkSession.range(1).select(F.lit(project).alias("project_id"), F.lit(name).alias("name"), F.lit(name_key(name)).alias("name_key"), F.lit("active").alias("state"), F.lit(0).cast("long").alias("search_generation"), now.alias("created_utc"), now.alias("updated_utc"))
    return projects.unionByName(new.select(*projects.columns)), folders.unionByName(_folders(folders, project, paths))


def update_project(projects: DataFrame, folders: DataFrame, project: str, now: Column, name: str | None = None, paths: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(projects, folders) with another name or other folders of a project."""
    own = F.col("project_id") == project
    if name is not None and projects.where((F.col("name_key") == name_key(name)) & ~own).limit(1).count():
        raise RequestError("project_exists", name)
    out = projects.withColumn("updated_utc", F.when(own, now).otherwise(F.col("updated_utc")))
    if name is not None:
        out = out.withColumn("name", F.when(own, F.lit(name)).otherwise(F.col("name"))).withColumn("name_key", F.when(own, F.lit(name_key(name))).otherwise(F.col("name_key")))
    return out.select(*projects.columns), folders if paths is None else folders.where(~own).unionByName(_folders(folders, project, paths))


def _folders(folders: DataFrame, project: str, paths: Sequence[str]) -> DataFrame:
    rows = [(f"{project}|{p}", project, p, p.upper()) for p in validate_folders(paths)]
    return folders.sparkSession.createDataFrame(rows, SCHEMAS["project_folders"]).select(*folders.columns)


def remove_project(store: Store, project: str) -> int:
    """Removes a project with all its rows in one commit; returns the new generation."""
    at = store.manifest()
    other = F.col("project_id") != project
    tables = {t: store.read(t, at) for t in at["tables"] if "project_id" in SCHEMAS[t].names}
    gone = store.read("documents", at).where(~other).select(F.col("id").alias("document_id"))
    return store.commit({t: df.where(other) if t not in OF_DOCUMENT else df.limit(0) for t, df in tables.items()}, gone, expected=at["generation"])


def set_paused(projects: DataFrame, jobs: DataFrame, revisions: DataFrame, project: str, paused: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, jobs, revisions) of a project paused or resumed. Pausing puts running jobs back and drops what they had begun."""
    own = F.col("project_id") == project
    out = projects.withColumn("state", F.when(own, F.lit("paused" if paused else "active")).otherwise(F.col("state")))
    if not paused:
        return out, jobs, revisions
    stopped = own & (F.col("state") == "running")
    back = jobs.withColumn("lease_until", F.when(stopped, F.lit(None)).otherwise(F.col("lease_until"))).withColumn("state", F.when(stopped, F.lit("queued")).otherwise(F.col("state")))
    return out, back, revisions.where(~own | F.coalesce(F.col("status") != "staging", F.lit(True)))


def runnable(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Jobs of projects that are not paused: what may be leased."""
    return jobs.join(projects.where("state = 'paused'").select("project_id"), "project_id", "left_anti")


def _requests(documents: DataFrame, kind: Column, now: Column) -> DataFrame:
    """documents: id, project_id, observation_epoch."""
    return documents.select(F.sha2(F.concat_ws("|", F.lit("job"), "id", F.col("observation_epoch").cast("string"), kind, now.cast("string")), 256).alias("id"), "project_id", F.col("id").alias("document_id"), kind.alias("kind"), F.col("observation_epoch").alias("expected_epoch"), now.alias("created_utc"))


def request_reindex(documents: DataFrame, jobs: DataFrame, project: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, jobs) after all documents of a project were asked to be indexed anew: each has a higher epoch and an open job."""
    asked = (F.col("project_id") == project) & ~F.col("tombstoned")
    docs = documents.withColumn("observation_epoch", F.col("observation_epoch") + asked.cast("long"))
    return docs, request_jobs(jobs, _requests(docs.where(asked), F.lit("reindex"), now))


def request_refresh(documents: DataFrame, jobs: DataFrame, revisions: DataFrame, passages: DataFrame, embeddings: DataFrame, policy: str, dimension: int, now: Column) -> DataFrame:
    """jobs with one for each document that lacks vectors of a policy; a document prepared by another version is indexed anew."""
    wanting = needs_refresh(passages, embeddings, policy, dimension).withColumnRenamed("document_id", "id")
    old = revisions.where("status = 'active'").select(F.col("document_id").alias("id"), (F.col("preparation_version") != PREPARATION).alias("_old"))
    docs = documents.where("NOT tombstoned").join(wanting, "id", "left_semi").join(old.groupBy("id").agg(F.max("_old").alias("_old")), "id", "left")
    return request_jobs(jobs, _requests(docs, F.when(F.coalesce("_old", F.lit(True)), F.lit("reindex")).otherwise(F.lit("refresh")), now))


def retry_failed(documents: DataFrame, jobs: DataFrame, project: str, now: Column) -> DataFrame:
    """jobs with a new one for each document of a project whose latest job failed, of its kind: a failed refresh is refreshed, others are indexed.
    Documents with an open job, and deleted ones, are left alone."""
    last = latest_by(jobs.where(F.col("project_id") == project), ["document_id"], [F.col("state").isin("queued", "running", "retry_wait"), F.col("created_utc"), F.col("id")])
    failed = last.where("state = 'failed'").select(F.col("document_id").alias("id"), F.when(F.col("kind") == "refresh", "refresh").otherwise("index").alias("_k"))
    docs = documents.where("NOT tombstoned").join(failed, "id")
    return request_jobs(jobs, _requests(docs, F.col("_k"), now))


def rename(documents: DataFrame, moved: DataFrame) -> DataFrame:
    """documents after files were renamed: each keeps its id, has its new names and a higher epoch. A document that had the new name before is
    deleted, unless it is the same one.

    moved: project_id, old_key, path, path_key, file_name, extension; the last of several moves of one file counts."""
    m = latest_by(moved, ["project_id", "old_key"], [F.col("path_key")]).select("project_id", F.col("old_key").alias("path_key"), *[F.col(c).alias(f"_{c}") for c in ("path", "path_key", "file_name", "extension")])
    j = documents.join(m, ["project_id", "path_key"], "left").withColumn("_hit", F.col("_path_key").isNotNull() & ~F.col("tombstoned"))
    out = j.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("path", "path_key", "file_name", "extension") else (F.col(c) + F.col("_hit").cast("long")).alias(c) if c == "observation_epoch" else F.col(c) for c in documents.columns], "_hit")
    taken = out.where("_hit").select("project_id", "path_key", F.col("id").alias("_by"))
    out = out.join(taken, ["project_id", "path_key"], "left").withColumn("_dead", F.col("_by").isNotNull() & ~F.col("_hit") & ~F.col("tombstoned"))
    return out.withColumn("observation_epoch", F.col("observation_epoch") + F.col("_dead").cast("long")).withColumn("active_revision_id", F.when(~F.col("_dead"), F.col("active_revision_id"))).withColumn("tombstoned", F.col("tombstoned") | F.col("_dead")).select(*documents.columns)


def exclude(exclusions: DataFrame, project: str, path: str, now: Column) -> DataFrame:
    """exclusions with a file; it stays excluded from the time it first was."""
    new = exclusions.sparkSession.range(1).select(F.lit(project).alias("project_id"), F.lit(path.upper()).alias("path_key"), now.alias("created_utc"))
    return exclusions.unionByName(new).groupBy("project_id", "path_key").agg(F.min("created_utc").alias("created_utc"))


def include(exclusions: DataFrame, project: str, path: str) -> DataFrame:
    return exclusions.where((F.col("project_id") != project) | (F.col("path_key") != path.upper()))


def hide_issues(acknowledgements: DataFrame, issues: DataFrame, now: Column) -> DataFrame:
    """acknowledgements with those of issues (project_id, signature)."""
    return acknowledgements.unionByName(issues.select("project_id", "signature", now.alias("created_utc"))).groupBy("project_id", "signature").agg(F.min("created_utc").alias("created_utc"))


def restore_issues(acknowledgements: DataFrame, issues: DataFrame) -> DataFrame:
    return acknowledgements.join(issues.select("project_id", "signature").distinct(), ["project_id", "signature"], "left_anti")


def commit_refresh(store: Store, vectors: DataFrame, policy: str, dimension: int) -> int:
    """Replaces the vectors of the documents in ``vectors`` (passage_id, project_id, document_id, revision_id, vector), all or none: each passage of
    theirs worth a vector must have one of the dimension, of its own revision. Returns the new generation."""
    at = store.manifest()
    documents = vectors.select("document_id").distinct()
    wanted = store.active_passages(None, at).where("semantic_eligible").join(documents, "document_id", "left_semi").select(F.col("id").alias("passage_id"), "revision_id")
    given = vectors.where(F.size("vector") == dimension).groupBy("passage_id", "revision_id").agg(F.count(F.lit(1)).alias("n"))
    wrong = wanted.join(given, ["passage_id", "revision_id"], "full").where("n IS NULL OR n <> 1").limit(1).count() or given.join(wanted, ["passage_id", "revision_id"], "left_anti").limit(1).count()
    if wrong:
        raise RequestError("incomplete_vectors", "each passage needs one vector")
    return store.commit({"embeddings": vectors.withColumn("policy_key", F.lit(policy))}, documents, expected=at["generation"])


def authorised_prefixes(requested: Sequence[str], folders: Sequence[str], limit: int = 500) -> list[str]:
    """Path prefixes of a search as absolute ones inside a project's folders: a relative one stands for that path in every folder. One that lies
    outside, or climbs out by "..", is refused, as are more than ``limit``."""
    roots = validate_folders(folders)
    out: dict[str, None] = {}
    for raw in requested:
        path = raw.replace("\\", "/")
        absolute = path.startswith("/") or path[1:3] == ":/"
        clean = [posixpath.normpath(path)] if absolute else [posixpath.normpath(f"{r}/{path}") for r in roots]
        for p, root in zip(clean, [None] if absolute else roots):
            if not any(p == r or p.startswith(r.rstrip("/") + "/") for r in (roots if root is None else [root])):
                raise RequestError("outside_folders", raw)
            out[p] = None
    if len(out) > limit:
        raise RequestError("too_many_prefixes", f"{limit} at most")
    return list(out)
