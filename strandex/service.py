"""Searching and reading an index: the operations that a caller has.

Each method makes one plan from one generation of the store. Searches rank by the stored text index and narrow rows, and read texts of the
candidates only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import for_display
from .operators import clauses as C
from .operators import inventory as I
from .operators import previews as V
from .operators import postings as P
from .operators import ranking as R
from .operators import trees
from .operators import vectors
from .operators.clauses import RequestError, SearchRequest
from .runtime import ship
from .store import Store

#: Fields of a query and the columns of passages that hold them.
COLUMNS = {"body": "body_text", "title": "title", "heading": "heading", "filename": "file_name", "path": "path", "content_name": "content_name", "sheet": "sheet", "email_subject": "email_subject"}


@dataclass
class SearchResult:
    """groups: ranked groups with their previews; suppressed: documents with more groups than were returned."""

    groups: DataFrame
    previews: DataFrame
    suppressed: DataFrame
    branches: dict[str, int]
    limit_reached: dict[str, bool]
    warnings: list[str]


@dataclass
class Service:
    store: Store
    embed: Callable[[str], Sequence[float]] | None = None

    def __post_init__(self) -> None:
        ship(self.store.spark)

    # Search

    def search(self, request: SearchRequest, project: str | None = None, condition: Column | None = None) -> SearchResult:
        """A keyword, semantic or hybrid search. A branch that cannot run is left out with a warning, and the other's weight counts alone."""
        request.validate()
        at = self.store.manifest()
        live = self.store.active_passages(project, at)
        if condition is not None:
            live = live.where(condition)
        section = request.scope == "section"
        key = "section_id" if section else "id"
        of_key = live.where("section_id IS NOT NULL") if section else live
        branches: dict[str, DataFrame] = {}
        counts: dict[str, int] = {}
        reached: dict[str, bool] = {}
        warnings: list[str] = []
        if request.mode != "semantic":
            ranked, more = self._keyword(of_key, at, request, key)
            ranked = ranked.persist()
            branches["keyword"], reached["keyword"] = ranked, more
            counts["keyword"] = ranked.count()
        semantic = None
        if request.mode != "keyword":
            if self.embed is None:
                warnings.append("semantic_unavailable")
                if request.mode == "semantic":
                    raise RequestError("semantic_unavailable", "no embedder")
            else:
                semantic, more = self._semantic(of_key, at, request, key)
                semantic = semantic.persist()
                branches["semantic"], reached["semantic"] = semantic.select(key, "rank"), more
                counts["semantic"] = semantic.count()
        fused = R.reciprocal_rank_fusion({b: d.select(key, "rank") for b, d in branches.items()}, key, request.weights)
        fused = fused.withColumn("score", F.round("score", 12))
        names = of_key.select(key, "document_id", "content_id", "path", "file_name", "ordinal", "id").join(fused.select(key), key, "left_semi")
        names = names.groupBy(key).agg(F.min_by(F.struct("document_id", "content_id", "path", "file_name"), F.struct("ordinal", "id")).alias("m")).select(key, "m.*") if section else names.drop("ordinal")
        hits = fused.join(names.drop("id") if section else names, key)
        group = ["document_id", "section_id"] if section else ["document_id", "content_id"]
        groups = R.group_hits(hits, group, "score", key)
        order = [F.col("score").desc(), F.col("document_id"), F.col(group[1])]
        returned = R.limit_per_document(groups, "document_id", order, request.groups_per_document, request.group_limit)
        suppressed = R.suppressed_sources(groups, returned, "document_id", group[1])
        members = self._members(self.store.active_passages(project, at) if section else of_key, fused, semantic, returned, group[1], key, section)
        shown = V.previews(members, "group_id", [c for c in request.clauses], request.previews_per_group, request.semantic_query, request.diversify_previews, "semantic" in branches)
        return SearchResult(R.ranked(returned, order, "position"), shown, suppressed, counts, reached, warnings)

    def _texts(self, live: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
        """(key, canonical texts of all fields) of a bounded number of rows: passages, or sections with the metadata of their first passage."""
        from .functions.text import canonical_column

        rows = live.withColumn("sheet", F.col("location.sheet")).select(*{key, "id", "ordinal"}, *COLUMNS.values()).join(wanted.select(key).distinct(), key, "left_semi")
        if key == "section_id":
            rows = sections_of(rows)
        return rows.select(key, *[F.coalesce("body_text", F.lit("")).alias("k_body") if f == "body" else canonical_column(F.coalesce(F.col(c), F.lit(""))).alias(f"k_{f}") for f, c in COLUMNS.items()])

    def _keyword(self, live: DataFrame, at: dict, request: SearchRequest, key: str) -> tuple[DataFrame, bool]:
        """Rows by the stored index: postings of the clauses' terms and prefixes meet the lengths of live rows; no text but that of the candidates
        is read, for the nearness of matches."""
        clauses, limit = request.clauses, request.candidate_limit
        scope = "section" if key == "section_id" else "passage"
        lengths = self.store.read("lengths", at).where(F.col("scope") == scope).select("id", "segment", "length").join(live.select(F.col(key).alias("id")).distinct(), "id", "left_semi").persist()
        stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).first()
        terms, prefixes = P.sought(clauses)
        found = P.clause_counts(self.store.postings(terms, prefixes, at).where(F.col("scope") == scope), clauses, ("id", "segment"))
        rows = lengths.join(found, ["id", "segment"]).select(F.col("id").alias(key), "length", "counts").persist()
        hits = P.clause_hits(clauses)
        e = C.combine(clauses, hits, request.minimum_should_match)
        score = P.bm25_counts(rows, clauses, request.field_weights, stats["n"], stats["avg"])
        scored = rows.select(key, e.matches.alias("matches"), e.candidate.alias("_candidate"), e.should_matched.alias("should_matched"), score.alias("score"), *([C.combine(clauses, hits, 1).matches.alias("_boost")] if C.has_boost(clauses, request.minimum_should_match) else []))
        positive = sum(c.occur != "must_not" for c in clauses)

        def branch(which: str) -> tuple[DataFrame, bool]:
            top = scored.where(which).orderBy(F.round("score", 9).desc(), key).limit(limit + 1).persist()
            more = top.count() > limit
            return R.ranked(top, [F.round("score", 9).desc(), F.col(key)], "rank").where(F.col("rank") <= limit).select(key, "rank", "matches", "should_matched"), more

        main, more = branch("_candidate")
        optional = branch("_boost")[0] if "_boost" in scored.columns else None
        if positive >= 2:
            near = self._texts(live, main if optional is None else main.select(key).unionByName(optional.select(key)), key).select(key, V.proximity_column(F.col("k_body"), clauses).alias("near"))
            main, optional = main.join(near, key, "left"), optional if optional is None else optional.join(near, key, "left")
        should = sum(c.occur == "should" for c in clauses)
        ranked = R.keyword_rerank(main, optional, key, should, positive, request.minimum_should_match, "near" if positive >= 2 else None)
        return ranked.select(key, F.col("keyword_rank").alias("rank")), more

    def _semantic(self, live: DataFrame, at: dict, request: SearchRequest, key: str) -> tuple[DataFrame, bool]:
        """Nearest passages first, then the clauses as a filter on them, so fewer than the limit may be left."""
        query = list(self.embed(request.semantic_query or ""))  # type: ignore[misc]
        ids = live.select(*{"id", key}, "section_offset", "display_text", "heading").withColumn("passage_id", F.col("id"))
        e = self.store.read("embeddings", at).join(ids, "passage_id", "left_semi")
        best = vectors.vector_top_k(e, query, request.candidate_limit + 1, "passage_id", "vector")
        more = best.count() > request.candidate_limit
        hits = best.limit(request.candidate_limit).join(ids, "passage_id")
        if request.clauses:
            rows = self._texts(live, hits, key)
            ok = C.evaluate(request.clauses, {f: F.col(f"k_{f}") for f in COLUMNS}, request.minimum_should_match)
            hits = hits.join(rows.where(ok.matches).select(key), key, "left_semi")
        if request.strict_threshold:
            hits = hits.where(F.col("score") >= request.similarity_threshold)
        grouped = hits.groupBy(key).agg(F.max("score").alias("similarity"), F.max_by("passage_id", F.struct("score", "passage_id")).alias("anchor"))
        grouped = grouped.withColumn("below_threshold", F.col("similarity") < request.similarity_threshold).withColumn("_order", F.col("similarity"))
        if key == "section_id":
            only = F.coalesce(F.trim("display_text") == F.trim("heading"), F.lit(False))
            bonus = R.corroboration(hits.select(key, "score", F.coalesce("section_offset", F.lit(0)).alias("section_offset"), "passage_id", only.alias("_only")), key, "score", "section_offset", "passage_id", "_only")
            grouped = grouped.join(bonus, key).withColumn("_order", F.col("similarity") + F.col("bonus")).drop("bonus")
        return R.ranked(grouped, [F.col("_order").desc(), F.col(key)], "rank").drop("_order"), more

    def _members(self, passages: DataFrame, fused: DataFrame, semantic: DataFrame | None, returned: DataFrame, group: str, key: str, section: bool) -> DataFrame:
        """Passages of the returned groups with what previews need."""
        keep = passages.join(fused.select(key, "score"), key).join(returned.select(group), group, "left_semi")
        out = keep.select(F.col(group).alias("group_id"), "id", "ordinal", F.col("display_text").alias("text"), "score", F.col("section_id").alias("section"), F.col("section_offset").alias("offset"), "heading", F.col("content_id").alias("content"), F.col("location.page").alias("page"),
                          F.col("location.sheet").alias("sheet"), F.col("location.cell_range").alias("cell_range"), F.col("location.email_part").alias("email_part"))
        if semantic is not None:
            out = out.join(semantic.select(F.col("anchor").alias("id"), F.col("similarity").alias("semantic")), "id", "left")
        return out

    # Reading

    def read_passages(self, ids: Sequence[str], before: int = 0, after: int = 0, project: str | None = None) -> DataFrame:
        """The passages asked for and their neighbours; ids that are no longer there have ``error`` stale_passage."""
        if not 1 <= len(ids) <= 50:
            raise RequestError("invalid_ids", "1 to 50 ids")
        spark = self.store.spark
        live = self.store.active_passages(project)
        asked = spark.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], "id string, asked int")
        anchors = live.join(F.broadcast(asked), "id", "left_semi").select("content_id", "ordinal")
        around = I.context_window(live, anchors, "content_id", "ordinal", before, after)
        full = asked.join(around, "id", "full")
        return full.withColumn("requested", F.col("asked").isNotNull()).withColumn("error", F.when(F.col("content_id").isNull(), "stale_passage")).orderBy("content_id", "ordinal", "asked")

    def read_section(self, section: str, offset: int = 0, limit: int = 20) -> DataFrame:
        live = self.store.active_passages().where(F.col("section_id") == section)
        return I.offset_page(live, [F.col("ordinal"), F.col("id")], offset, limit)

    def list_documents(self, project: str, sort: str = "path", ascending: bool = True, after: Sequence | None = None, limit: int = 50, condition: Column | None = None) -> DataFrame:
        """A page of the inventory: documents with counts, their job's state, errors and status."""
        at = self.store.manifest()
        docs = self.store.read("documents", at).where((F.col("project_id") == project) & ~F.col("tombstoned"))
        counts = self.store.read("passages", at).groupBy(F.col("document_id").alias("id"), F.col("revision_id").alias("active_revision_id")).agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("content_id").alias("contents"))
        jobs = I.latest_by(self.store.read("index_jobs", at).select("document_id", "state", "created_utc", "id"), ["document_id"], [F.col("state").isin("queued", "running", "retry_wait"), F.col("created_utc"), F.col("id")]).select(F.col("document_id").alias("id"), F.col("state").alias("job_state"))
        errors = self.store.read("errors", at).groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("errors"), F.max_by(F.concat_ws(": ", "code", "message"), "created_utc").alias("last_error"))
        out = docs.join(counts, ["id", "active_revision_id"], "left").join(jobs, "id", "left").join(errors, "id", "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("passages", "contents", "errors")}).withColumn("status", I.document_status(F.coalesce("job_state", F.lit("")), F.col("errors"), F.col("available")))
        if condition is not None:
            out = out.where(condition)
        return I.keyset_page(out, [(sort, ascending), ("id", True)], after, limit)

    def document_info(self, document: str) -> DataFrame:
        """One row: the document with its numbers of contents, passages by method, and sections."""
        at = self.store.manifest()
        docs = self.store.read("documents", at).where(F.col("id") == document)
        p = self.store.read("passages", at).where(F.col("document_id") == document).join(docs.select(F.col("active_revision_id").alias("revision_id")), "revision_id", "left_semi")
        methods = I.histogram(p, ["document_id"], "extraction_method", "methods").withColumnRenamed("document_id", "id")
        counts = p.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("section_id").alias("sections"), F.count_distinct("content_id").alias("contents"))
        return docs.join(counts, "id", "left").join(methods, "id", "left")

    def list_attachments(self, document: str, offset: int = 0, limit: int = 50) -> DataFrame:
        """Contents of a document in the order of its tree, with depth, chain of names and number of descendants."""
        at = self.store.manifest()
        n = self.store.read("content_nodes", at).where(F.col("document_id") == document)
        n = n.join(self.store.read("documents", at).where(F.col("id") == document).select(F.col("active_revision_id").alias("revision_id")), "revision_id", "left_semi")
        t = trees.expand(n, "id", "parent_id", "name", "ordinal")
        out = t.join(trees.descendants(t), "id", "left").join(n.select("id", "mime_type", "relationship", "status"), "id").withColumn("descendants", F.coalesce("descendants", F.lit(0)))
        return I.offset_page(out.where("depth > 0"), [F.col("sort_path")], offset, limit)

    def resolve_local_file(self, content: str) -> DataFrame:
        """(path, chain): the file that a content lies in, and the names that lead to it."""
        at = self.store.manifest()
        node = self.store.read("content_nodes", at).where(F.col("id") == content).select("document_id").distinct()
        n = self.store.read("content_nodes", at).join(node, "document_id", "left_semi")
        chain = trees.expand(n, "id", "parent_id", "name", "ordinal").where(F.col("id") == content).join(n.select("id", "document_id"), "id").select("document_id", "chain")
        return self.store.read("documents", at).where("NOT tombstoned").select(F.col("id").alias("document_id"), "path").join(chain, "document_id").select("path", "chain")

    def materialize_content(self, content: str) -> bytes:
        """The bytes of a content: its file is opened and the chain of attachments walked again. A file that is not the one indexed is refused."""
        import hashlib

        from .sources.extract import materialise, read_files

        at = self.store.manifest()
        nodes = self.store.read("content_nodes", at)
        document = nodes.where(F.col("id") == content).select("document_id").first()
        if document is None:
            raise RequestError("unknown_content", content)
        doc = self.store.read("documents", at).where((F.col("id") == document[0]) & ~F.col("tombstoned")).select("path", "file_name", "sha256", "active_revision_id").first()
        if doc is None:
            raise RequestError("stale_content", content)
        tree = trees.expand(nodes.where((F.col("document_id") == document[0]) & (F.col("revision_id") == doc["active_revision_id"])), "id", "parent_id", "name", "ordinal").where(F.col("id") == content).select("sort_path").first()
        if tree is None:
            raise RequestError("stale_content", content)
        data = read_files(self.store.spark, doc["path"]).select("content").first()[0]
        if hashlib.sha256(data).hexdigest() != doc["sha256"]:
            raise RequestError("changed_file", doc["path"])
        found = materialise(bytes(data), doc["file_name"], [int(k) for k in tree["sort_path"].split(".")[1:]])
        if found is None:
            raise RequestError("unknown_content", content)
        return found

    def list_projects(self) -> DataFrame:
        at = self.store.manifest()
        docs = self.store.read("documents", at).where("NOT tombstoned").groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"))
        jobs = I.summary(self.store.read("index_jobs", at), ["project_id"], "state", ["queued", "running", "retry_wait", "failed", "completed"], "not_before", "document_id", "failed")
        return self.store.read("projects", at).join(docs, "project_id", "left").join(jobs, "project_id", "left")

    def verify_previews(self, result: SearchResult) -> bool:
        """Whether every preview is literally what its passage holds at its place."""
        from .operators.metrics import literal_citation

        p = self.store.active_passages().select("id", "display_text")
        return result.previews.join(p, "id").where(~literal_citation(F.col("display_text"), F.col("start"), F.col("length"), F.col("excerpt"))).count() == 0


def sections_of(passages: DataFrame) -> DataFrame:
    """One row a section of passages: its whole canonical text, with the other columns of its first passage."""
    first = passages.where("section_id IS NOT NULL").groupBy("section_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "body_text"))), lambda x: x["body_text"]), " ").alias("_body"),
        F.min_by(F.struct(*[c for c in passages.columns if c not in ("section_id", "body_text")]), F.struct("ordinal", "id")).alias("_m"))
    return first.select("section_id", F.col("_body").alias("body_text"), "_m.*")


def text_index(passages: DataFrame) -> dict[str, DataFrame]:
    """The tables of the text index for passages of a store: each passage, and each section as one text with the metadata of its first passage."""
    from .functions.text import canonical_column
    from .operators.postings import index_rows

    carry = ["project_id", "document_id", "revision_id"]
    rows = passages.withColumn("sheet", F.col("location.sheet")).select("id", "section_id", "ordinal", *carry, *COLUMNS.values())
    out: dict[str, DataFrame] = {}
    for scope, key, part in (("passage", "id", rows), ("section", "section_id", sections_of(rows))):
        made = part.select(key, *carry, *[F.coalesce("body_text", F.lit("")).alias("k_body") if f == "body" else canonical_column(F.coalesce(F.col(c), F.lit(""))).alias(f"k_{f}") for f, c in COLUMNS.items()])
        postings, lengths = index_rows(made, scope, key, {f: f"k_{f}" for f in COLUMNS}, carry)
        for name, df in (("postings", postings), ("lengths", lengths)):
            out[name] = out[name].unionByName(df) if name in out else df
    return out


PAGES = T.StructType([T.StructField("position", T.LongType()), T.StructField("page", T.LongType())])


def paged(groups: DataFrame, document: str, size: int, cap: int) -> DataFrame:
    """Ranked groups with the page that each is shown on: at most ``cap`` groups of a document a page, the rest later. Groups are those that
    a search returned, of bounded number."""
    kind = groups.select("position", document)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position")
        return pd.DataFrame({"position": part["position"], "page": V.page_with_diversity(list(part[document]), size, cap)})

    return groups.join(kind.groupBy().applyInPandas(run, PAGES), "position")


def live_only(groups: DataFrame, ids: str, live: DataFrame) -> DataFrame:
    """Groups of an earlier search whose passages are all still there."""
    each = groups.select("position", F.explode(ids).alias("id"))
    gone = each.join(live.select("id"), "id", "left_anti").select("position").distinct()
    return groups.join(gone, "position", "left_anti")


def with_limits(request: SearchRequest, **changes) -> SearchRequest:
    return replace(request, **changes).validate()


def title_of(title: str | None, heading: str | None, name: str) -> str:
    """What a group is called."""
    return next((x for x in (for_display(title), for_display(heading)) if x), name)
