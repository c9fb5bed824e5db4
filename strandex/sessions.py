"""Pages of a search that a caller fetches one after the other, and the shapes of a response."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.clauses import RequestError
from .service import SearchResult, Service, live_only, paged

#: How long a session stays without being used, and how many are held (the oldest unused goes first).
SESSION_SECONDS, SESSIONS = 600, 64


@dataclass
class Session:
    groups: DataFrame  # ranked groups with their page; as many as a search returns, 100 at most
    previews: DataFrame
    pages: int
    used: float


class Sessions:
    """Searches whose groups are shown page by page. A cursor is the session's id and the page; groups whose documents have gone are left out."""

    def __init__(self, service: Service, page_size: int = 10, per_document: int = 2, clock: Callable[[], float] = time.monotonic):
        self.service, self.size, self.cap, self.clock = service, page_size, per_document, clock
        self.held: OrderedDict[str, Session] = OrderedDict()

    def start(self, result: SearchResult) -> tuple[DataFrame, str | None]:
        """(first page, cursor of the second or None)."""
        groups = paged(result.groups, "document_id", self.size, self.cap).persist()
        last = groups.agg(F.max("page")).first()[0]
        name = uuid.uuid4().hex
        self.held[name] = Session(groups, result.previews.persist(), 0 if last is None else last + 1, self.clock())
        self._drop()
        return self._page(name, 0)

    def next(self, cursor: str) -> tuple[DataFrame, str | None]:
        """(the cursor's page, cursor of the one after it or None). A cursor that has expired, or never was, is refused."""
        self._drop()
        name, _, page = cursor.partition(".")
        if name not in self.held or not page.isdigit() or int(page) >= self.held[name].pages:
            raise RequestError("invalid_cursor", "start the search again")
        self.held[name].used = self.clock()
        self.held.move_to_end(name)
        return self._page(name, int(page))

    def previews(self, cursor: str) -> DataFrame:
        name = cursor.partition(".")[0]
        if name not in self.held:
            raise RequestError("invalid_cursor", "start the search again")
        return self.held[name].previews

    def _page(self, name: str, page: int) -> tuple[DataFrame, str | None]:
        s = self.held[name]
        shown = s.groups.where(F.col("page") == page)
        live = self.service.store.active_passages().select("id").unionByName(self.service.store.active_passages().where("section_id IS NOT NULL").select(F.col("section_id").alias("id")))
        return live_only(shown.withColumn("_ids", F.array("best")), "_ids", live).drop("_ids"), f"{name}.{page + 1}" if page + 1 < s.pages else None

    def _drop(self) -> None:
        now = self.clock()
        for name in list(self.held):
            if now - self.held[name].used > SESSION_SECONDS or len(self.held) > SESSIONS:
                gone = self.held.pop(name)
                gone.groups.unpersist(), gone.previews.unpersist()


def respond(result: SearchResult, detail: str = "compact") -> DataFrame:
    """(position, response): each group as a JSON text. ``compact`` has its names, score and excerpts; ``full`` also ids, places and the clauses of each
    excerpt, and how many hits the group has."""
    if detail not in ("compact", "full"):
        raise RequestError("invalid_detail", detail)
    group = "content_id" if "content_id" in result.groups.columns else "section_id"
    shown = result.previews
    fields = ["rank", "excerpt"] if detail == "compact" else [c for c in shown.columns if c != "group_id"]
    excerpts = shown.groupBy(F.col("group_id").alias(group)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("previews"))
    kept = ["position", "document_id", group, "score"] if detail == "compact" else [c for c in result.groups.columns]
    return result.groups.join(excerpts, group, "left").select("position", F.to_json(F.struct(*kept, "previews")).alias("response"))


class VectorCache:
    """The vectors of a project as one generation of a policy has them, kept for the searches that follow. A newer generation takes an older one's
    place; of several projects the one used longest ago goes first."""

    def __init__(self, service: Service, most: int = 4):
        self.service, self.most = service, most
        self.held: OrderedDict[tuple[str | None, str], tuple[int, DataFrame]] = OrderedDict()

    def vectors(self, project: str | None, policy: str) -> DataFrame:
        """(passage_id, document_id, vector) of live passages; executors keep them in memory, or on disk, as far as there is room."""
        at = self.service.store.manifest()
        key = (project, policy)
        if key in self.held and self.held[key][0] == at["generation"]:
            self.held.move_to_end(key)
            return self.held[key][1]
        live = self.service.store.active_passages(project, at).select(F.col("id").alias("passage_id"), "revision_id")
        rows = self.service.store.read("embeddings", at).where(F.col("policy_key") == policy).join(live, ["passage_id", "revision_id"], "left_semi").select("passage_id", "document_id", "vector").persist()
        for old in [key] if key in self.held else []:
            self.held.pop(old)[1].unpersist()
        self.held[key] = (at["generation"], rows)
        while len(self.held) > self.most:
            self.held.popitem(last=False)[1][1].unpersist()
        return rows
