import json

import pytest
from pyspark.sql import functions as F

from strandex.indexing import index_folder
from strandex.operators.clauses import Clause, RequestError, SearchRequest
from strandex.operators.vectors import hashing_embedder
from strandex.service import Service, paged
from strandex.store import Store

from .test_sources import MAIL, zipped


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    (folder / "guide.md").write_text("# Pump\n\nThe pump valve needs oil every month. Keep the pump clean.\n\n# Motor\n\nThe motor runs hot near the valve.\n")
    (folder / "stock.csv").write_text("Depot,Item\nNorth,pump\nSouth,motor\n")
    (folder / "data.json").write_text(json.dumps({"pump": {"serial": "AB12"}}))
    (folder / "mail.eml").write_bytes(MAIL)
    (folder / "pack.zip").write_bytes(zipped([("note.txt", "A note about the pump valve."), ("bad.json", "{")]))
    store = Store(spark, str(tmp_path_factory.mktemp("index")))
    embed = hashing_embedder(32)
    assert index_folder(store, "p", str(folder), lambda c: embed(c), "hash-32") == {"indexed": 5, "unchanged": 0, "deleted": 0}
    vector = lambda t: spark.range(1).select(embed(F.lit(t)).alias("v")).first()[0]
    return Service(store, vector), folder, embed


def found(result):
    return [r["best"] for r in result.groups.orderBy("position").collect()]


def test_keyword_search(index):
    service, _, _ = index
    live = {r["id"]: r for r in service.store.active_passages("p").collect()}
    r = service.search(SearchRequest((Clause("a", "pump valve", match="phrase"),), mode="keyword"), "p")
    texts = [live[i]["display_text"] for i in found(r)]
    assert len(texts) == 2 and all("pump valve" in t.lower() for t in texts)
    assert service.verify_previews(r) and r.previews.count() >= 2
    r = service.search(SearchRequest((Clause("a", "pump"), Clause("n", "valve", "must_not"), Clause("s", "serial", "should")), mode="keyword"), "p")
    assert live[found(r)[0]]["file_name"] == "data.json"
    r = service.search(SearchRequest((Clause("a", "guide", fields=("filename",)),), mode="keyword", scope="section"), "p")
    assert r.groups.count() == 2


def test_semantic_and_hybrid_search(index):
    service, _, _ = index
    live = {r["id"]: r["display_text"] for r in service.store.active_passages("p").collect()}
    r = service.search(SearchRequest(mode="semantic", semantic_query="The motor runs hot near the valve"), "p")
    assert "motor runs hot" in live[found(r)[0]]
    r = service.search(SearchRequest((Clause("a", "pump"),), semantic_query="pump oil month", mode="hybrid", groups_per_document=1, group_limit=2), "p")
    assert r.groups.count() == 2 and set(r.branches) == {"keyword", "semantic"} and service.verify_previews(r)
    assert paged(r.groups, "document_id", 1, 1).count() == 2
    only = Service(service.store).search(SearchRequest((Clause("a", "pump"),), semantic_query="x", mode="hybrid"), "p")
    assert only.warnings == ["semantic_unavailable"] and only.groups.count() > 0
    with pytest.raises(RequestError):
        Service(service.store).search(SearchRequest(mode="semantic", semantic_query="x"), "p")


def test_reading(index):
    service, _, _ = index
    p = service.store.active_passages("p").where("file_name = 'guide.md'").orderBy("ordinal").collect()
    got = service.read_passages([p[0]["id"], "missing"], 0, 1).collect()
    assert {(r["id"], r["error"]) for r in got} == {(p[0]["id"], None), (p[1]["id"], None), ("missing", "stale_passage")}
    assert [r["id"] for r in service.read_section(p[0]["section_id"]).collect()] == [x["id"] for x in p if x["section_id"] == p[0]["section_id"]]
    docs = service.list_documents("p", limit=3).collect()
    assert len(docs) == 4 and [d["path"] for d in docs] == sorted(d["path"] for d in docs)
    pack = next(d for d in service.list_documents("p", limit=9).collect() if d["file_name"] == "pack.zip")
    assert pack["errors"] == 1 and pack["status"] == "error"
    assert [r["name"] for r in service.list_attachments(pack["id"]).collect()] == ["note.txt", "bad.json"]
    note = service.list_attachments(pack["id"]).first()["id"]
    where = service.resolve_local_file(note).first()
    assert where["path"].endswith("pack.zip") and where["chain"] == ["note.txt"]
    assert service.document_info(pack["id"]).first()["passages"] == 1


def test_sessions_shapes_and_bytes(index):
    from strandex.sessions import SESSION_SECONDS, Sessions, VectorCache, respond

    service, folder, _ = index
    r = service.search(SearchRequest((Clause("a", "pump"),), mode="keyword"), "p")
    now = [0.0]
    s = Sessions(service, 2, 1, lambda: now[0])
    first, cursor = s.start(r)
    seen = [x["position"] for x in first.collect()]
    while cursor:
        held = cursor
        page, cursor = s.next(held)
        got = page.collect()
        assert len(got) <= 2 and len({x["document_id"] for x in got}) == len(got)
        seen += [x["position"] for x in got]
    assert sorted(seen) == [x["position"] for x in r.groups.orderBy("position").collect()] and s.previews(held).count() > 0
    now[0] = SESSION_SECONDS + 1.0
    for bad in (held, "x.1"):
        with pytest.raises(RequestError):
            s.next(bad)
    compact, full = ({x["position"]: json.loads(x["response"]) for x in respond(r, d).collect()} for d in ("compact", "full"))
    assert set(compact) == set(full) and set(compact[1]["previews"][0]) == {"rank", "excerpt"} and {"start", "length"} <= set(full[1]["previews"][0])
    pack = next(d for d in service.list_documents("p", limit=9).collect() if d["file_name"] == "pack.zip")
    note = service.list_attachments(pack["id"]).first()["id"]
    assert service.materialize_content(note) == b"A note about the pump valve."
    with pytest.raises(RequestError):
        service.materialize_content("nothing")
    cache = VectorCache(service, 1)
    v = cache.vectors("p", "hash-32")
    assert v.count() > 0 and cache.vectors("p", "hash-32") is v and cache.vectors("p", "other").count() == 0 and len(cache.held) == 1


def test_files_change(index):
    service, folder, embed = index
    store = service.store
    before = store.generation
    assert index_folder(store, "p", str(folder), lambda c: embed(c), "hash-32")["indexed"] == 0 and store.generation == before
    (folder / "guide.md").write_text("# Pump\n\nEntirely new text about gearboxes, longer than it was before by some words.\n")
    (folder / "stock.csv").unlink()
    assert index_folder(store, "p", str(folder), lambda c: embed(c), "hash-32") == {"indexed": 1, "unchanged": 3, "deleted": 1}
    r = service.search(SearchRequest((Clause("a", "gearboxes"),), mode="keyword"), "p")
    assert r.groups.count() == 1
    assert service.search(SearchRequest((Clause("a", "north"),), mode="keyword"), "p").groups.count() == 0
    assert store.active_passages("p").where("display_text LIKE '%needs oil%'").count() == 0


def test_renames_keep_ids_and_missing_folders_delete_nothing(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "one.txt").write_text("The pump valve needs oil every month.")
    (folder / "two.txt").write_text("Another text about motors and other things.")
    store = Store(spark, str(tmp_path / "i"))
    index_folder(store, "p", str(folder))
    ids = {r["file_name"]: r["id"] for r in store.read("documents").collect()}
    (folder / "one.txt").rename(folder / "first.txt")
    assert index_folder(store, "p", str(folder)) == {"indexed": 1, "unchanged": 1, "deleted": 0, "renamed": 1}
    live = {r["file_name"]: r["id"] for r in store.read("documents").where("NOT tombstoned").collect()}
    assert live == {"first.txt": ids["one.txt"], "two.txt": ids["two.txt"]}
    s = Service(store)
    assert s.search(SearchRequest((Clause("a", "first", fields=("filename",)),), mode="keyword"), "p").groups.count() == 1
    assert s.search(SearchRequest((Clause("a", "one", fields=("filename",)),), mode="keyword"), "p").groups.count() == 0
    store.compact()
    assert store.vacuum() > 0 and s.search(SearchRequest((Clause("a", "pump valve", match="phrase"),), mode="keyword"), "p").groups.count() == 1
    (folder / "first.txt").rename(tmp_path / "kept.txt")
    (folder / "two.txt").rename(tmp_path / "kept2.txt")
    assert index_folder(store, "p", str(folder)) == {"indexed": 0, "unchanged": 0, "deleted": 0, "unavailable": 2}
    assert store.read("documents").where("NOT tombstoned AND NOT available").count() == 2 and store.active_passages("p").count() == 2
    folder.rmdir()
    assert index_folder(store, "p", str(folder))["unavailable"] == 2


def test_stored_index_finds_what_a_scan_finds(spark, index):
    """Counts of terms, prefixes and phrases from postings against the texts themselves."""
    from strandex.operators import postings as P

    rows = [(f"r{i}", t, h) for i, (t, h) in enumerate([("a b a b a", "x"), ("the pump valve the pump", "pump"), ("valve pump", None), ("", "pumps"), (None, "a")])]
    df = spark.createDataFrame(rows, "id string, body string, heading string")
    postings, lengths = P.index_rows(df, "s", "id", {"body": "body", "heading": "heading"})
    assert {r["id"]: r["length"] for r in lengths.collect()} == {"r0": 6, "r1": 6, "r2": 2, "r3": 1, "r4": 1}
    clauses = [Clause("p", "a b a", match="phrase"), Clause("q", "pump", match="prefix"), Clause("t", "pump valve", match="phrase", fields=("body",)), Clause("u", "a")]
    got = {r["id"]: r["counts"] for r in P.clause_counts(postings, clauses).collect()}
    assert got == {"r0": {"0|body": 1, "3|body": 3}, "r1": {"1|body": 2, "1|heading": 1, "2|body": 1}, "r2": {"1|body": 1}, "r3": {"1|heading": 1}, "r4": {"3|heading": 1}}
    assert P.clause_counts(postings.limit(0), clauses).count() == 0
    plan = index[0].store.postings(["pump"], ["val"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "head" in plan
