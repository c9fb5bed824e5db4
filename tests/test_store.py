import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandex import store as S
from strandex.operators.clauses import RequestError
from strandex.streaming import events as E

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def rows(spark, table, values):
    names = S.SCHEMAS[table].names
    return spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], S.SCHEMAS[table])


def test_commits_replace_documents_and_nothing_else(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "index"))
    assert s.generation == 0 and s.read("passages").count() == 0
    docs = rows(spark, "documents", [{"id": d, "project_id": "p", "path_key": d, "tombstoned": d == "c", "active_revision_id": f"{d}1"} for d in "abc"])
    passages = rows(spark, "passages", [{"id": f"{d}{i}", "document_id": d, "revision_id": f"{d}1", "project_id": "p"} for d in "abc" for i in range(3)])
    assert s.commit({"documents": docs, "passages": passages}, passages) == 1
    before = s.manifest()
    new = rows(spark, "passages", [{"id": "a9", "document_id": "a", "revision_id": "a2", "project_id": "p"}])
    assert s.commit({"passages": new}, new, expected=1) == 2
    assert sorted(r["id"] for r in s.read("passages").collect()) == ["a9", "b0", "b1", "b2", "c0", "c1", "c2"]
    assert s.read("passages", before).count() == 9  # a reader of the first generation still sees it
    assert sorted(r["id"] for r in s.active_passages("p").collect()) == ["b0", "b1", "b2"]
    with pytest.raises(RequestError):
        s.commit({"passages": new}, new, expected=1)
    assert s.generation == 2 and s.vacuum() >= 1 and s.read("passages").count() == 7
    s.commit({"exclusions": rows(spark, "exclusions", [{"project_id": "p", "path_key": "b"}])})
    assert s.active_passages("p").count() == 0


def test_observing_and_deleting(spark):
    docs = rows(spark, "documents", [{"id": "1", "project_id": "p", "folder_id": "f", "path_key": "a", "size": 5, "modified_utc": T0, "observation_epoch": 3, "tombstoned": False}, {"id": "2", "project_id": "p", "folder_id": "f", "path_key": "b", "size": 5, "modified_utc": T0, "observation_epoch": 1, "tombstoned": True},
                                     {"id": "3", "project_id": "p", "folder_id": "g", "path_key": "c", "size": 5, "modified_utc": T0, "observation_epoch": 1, "tombstoned": False}])
    kind = "id string, project_id string, folder_id string, path string, path_key string, file_name string, extension string, size long, modified_utc timestamp"
    seen = spark.createDataFrame([("9", "p", "f", "a", "a", "a", ".txt", 5, T0), ("8", "p", "f", "b", "b", "b", ".txt", 5, T0), ("7", "p", "f", "d", "d", "d", ".txt", 1, T0), ("7", "p", "f", "d", "d", "d", ".txt", 2, at(5))], kind)
    out, changed = S.observe(docs, seen)
    got = {r["path_key"]: (r["id"], r["observation_epoch"], r["tombstoned"], r["size"]) for r in out.collect()}
    assert got == {"a": ("1", 3, False, 5), "b": ("2", 2, False, 5), "c": ("3", 1, False, 5), "d": ("7", 1, False, 2)}
    assert {r["id"] for r in changed.collect()} == {"2", "7"}
    gone = S.reconcile(docs, seen.where("path_key = 'b'").select("project_id", "path_key"), spark.createDataFrame([("f",)], "folder_id string"))
    assert [r["id"] for r in gone.collect()] == ["1"]
    dead = {r["id"]: (r["tombstoned"], r["observation_epoch"]) for r in S.tombstone(docs, gone).collect()}
    assert dead == {"1": (True, 4), "2": (True, 1), "3": (False, 1)}


def test_jobs(spark):
    jobs = rows(spark, "index_jobs", [])
    ask = spark.createDataFrame([("j1", "p", "d", "index", 1, at(1)), ("j2", "p", "d", "reindex", 2, at(2)), ("j3", "p", "e", "index", 1, at(3))], "id string, project_id string, document_id string, kind string, expected_epoch long, created_utc timestamp")
    jobs = S.request_jobs(jobs, ask)
    assert {(r["id"], r["kind"], r["expected_epoch"]) for r in jobs.collect()} == {("j1", "reindex", 2), ("j3", "index", 1)}
    now = lambda s: F.lit(at(s))
    jobs = S.lease(jobs, now(10), 1)
    assert {(r["id"], r["state"], r["attempt"]) for r in jobs.collect()} == {("j1", "running", 1), ("j3", "queued", 0)}
    jobs = S.fail(jobs, spark.createDataFrame([("j1", True)], "id string, retryable boolean"), now(20))
    r = jobs.where("id = 'j1'").first()
    assert (r["state"], r["not_before"]) == ("retry_wait", at(25))
    assert S.lease(jobs, now(21), 5).where("id = 'j1'").first()["state"] == "retry_wait"
    jobs = S.lease(jobs, now(26), 5)
    docs = rows(spark, "documents", [{"id": "d", "observation_epoch": 3}, {"id": "e", "observation_epoch": 1}])
    jobs = S.complete(jobs, spark.createDataFrame([("j1", 2), ("j3", 1)], "id string, epoch long"), docs)
    assert {(r["id"], r["state"], r["expected_epoch"]) for r in jobs.collect()} == {("j1", "queued", 3), ("j3", "completed", 1)}
    jobs = S.request_jobs(jobs, ask)
    assert jobs.where("state IN ('queued', 'running', 'retry_wait')").groupBy("document_id").count().where("count > 1").count() == 0
    again, revisions = S.recover(S.lease(jobs, now(40), 9), rows(spark, "revisions", [{"id": "r", "status": "staging"}, {"id": "s", "status": "active"}]))
    assert again.where("state = 'running'").count() == 0 and [r["id"] for r in revisions.collect()] == ["s"]
    assert S.prune_jobs(again).count() == again.count()


def test_revisions_refresh_and_errors(spark):
    old = rows(spark, "revisions", [{"id": "1", "document_id": "d", "status": "active"}, {"id": "2", "document_id": "e", "status": "active"}])
    got = {r["id"]: r["status"] for r in S.activate(old, rows(spark, "revisions", [{"id": "3", "document_id": "d", "status": "staging"}])).collect()}
    assert got == {"1": "superseded", "2": "active", "3": "active"}
    passages = rows(spark, "passages", [{"id": "p", "revision_id": "1", "document_id": "d", "semantic_eligible": True}, {"id": "q", "revision_id": "2", "document_id": "e", "semantic_eligible": True}])
    vectors = rows(spark, "embeddings", [{"passage_id": "p", "revision_id": "1", "policy_key": "k", "vector": [1.0, 0.0]}, {"passage_id": "q", "revision_id": "2", "policy_key": "old", "vector": [1.0, 0.0]}])
    assert [r["document_id"] for r in S.needs_refresh(passages, vectors, "k", 2).collect()] == ["e"]
    errors = spark.createDataFrame([("d", "a.zip/b.eml/c.txt"), ("d", "only"), ("d", "twice"), ("d", None)], "document_id string, component string")
    nodes = spark.createDataFrame([("d", "n1", "a.zip", "a.zip"), ("d", "n2", "a.zip/b.eml", "b.eml"), ("d", "n3", "x/only", "only"), ("d", "n4", "x/twice", "twice"), ("d", "n5", "y/twice", "twice")], "document_id string, content_id string, key string, name string")
    assert {r["component"]: r["content_id"] for r in S.bind_errors(errors, nodes).collect()} == {"a.zip/b.eml/c.txt": "n2", "only": "n3", "twice": None, None: None}
    with pytest.raises(RequestError):
        S.validate_folders(["/a/b", "/a/b/c"])


def test_debounce(spark):
    kind = "project_id string, path string, kind string, old_path string, ts timestamp"
    df = spark.createDataFrame([("p", "a", "created", None, at(0)), ("p", "a", "changed", None, at(0.5)), ("p", "a", "deleted", None, at(5)), ("p", "b", "rename", "c", at(1)), ("p", "b", "changed", None, at(1.2))], kind)
    got = sorted((r["path"], r["kind"], r["events"], r["reconcile"]) for r in E.debounce(df, ["project_id", "path"], "ts").collect())
    assert got == [("a", "changed", 2, False), ("a", "deleted", 1, False), ("b", "changed", 2, True)]


def test_job_state_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    kind = "document_id long, kind string, ts timestamp, seq long"
    spark.createDataFrame([(1, "created", at(0), 0), (1, "lease", at(1), 1), (1, "failed", at(2), 2), (2, "created", at(0), 3)], kind).coalesce(1).write.parquet(source + "/a")
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(source)

    def run():
        q = E.job_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: out.extend(b.collect())).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([(1, "lease", at(3), 4), (1, "completed", at(4), 5)], kind).coalesce(1).write.parquet(source + "/b")
    run()
    last = {r["document_id"]: (r["state"], r["attempt"], r["epoch"]) for r in out}
    assert last == {1: ("completed", 2, 1), 2: ("queued", 0, 1)}


def test_two_writers_and_one_manifest(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "index"))
    row = rows(spark, "acknowledgements", [{"project_id": "p", "signature": "x"}])
    assert s.files.create(str(tmp_path / "m.json"), "{}") and not s.files.create(str(tmp_path / "m.json"), "[]")
    assert s.commit({"acknowledgements": row}) == 1
    one = s.manifest
    s.manifest = lambda: {"generation": 0, "tables": {}}  # a writer that read before the other's commit
    with pytest.raises(RequestError):
        s.commit({"acknowledgements": row})
    s.manifest = one
    assert s.generation == 1 and s.read("acknowledgements").count() == 1


def test_projects(spark, tmp_path):
    now = F.lit(T0).cast("timestamp")
    projects, folders = S.create_project(rows(spark, "projects", []), rows(spark, "project_folders", []), "p", "First", ["/a", "/b"], now)
    projects, folders = S.create_project(projects, folders, "q", "Second", ["/c"], now)
    for name, paths, code in (("FIRST", ["/x"], "project_exists"), ("Third", ["/x", "/x/y"], "nested_folder")):
        with pytest.raises(RequestError) as e:
            S.create_project(projects, folders, "r", name, paths, now)
        assert e.value.code == code
    projects, folders = S.update_project(projects, folders, "p", now, "Renamed", ["/z"])
    assert {r["path"] for r in folders.collect()} == {"/z", "/c"} and {r["name"] for r in projects.collect()} == {"Renamed", "Second"}
    store = S.Store(spark, str(tmp_path / "i"))
    docs = rows(spark, "documents", [{"id": d, "project_id": p, "path_key": d, "tombstoned": False, "active_revision_id": "r"} for d, p in (("a", "p"), ("b", "q"))])
    passages = rows(spark, "passages", [{"id": f"{d}1", "document_id": d, "revision_id": "r", "project_id": p} for d, p in (("a", "p"), ("b", "q"))])
    store.commit({"projects": projects, "project_folders": folders, "documents": docs, "passages": passages}, passages)
    S.remove_project(store, "p")
    assert [r["project_id"] for r in store.read("projects").collect()] == ["q"] and [r["id"] for r in store.read("passages").collect()] == ["b1"] and store.read("documents").count() == 1


def test_pausing_reindexing_and_retrying(spark):
    now = F.lit(at(100)).cast("timestamp")
    projects = rows(spark, "projects", [{"project_id": p, "state": "active"} for p in "pq"])
    jobs = rows(spark, "index_jobs", [{"id": "1", "project_id": "p", "document_id": "a", "kind": "index", "state": "running", "lease_until": T0, "created_utc": T0, "expected_epoch": 1}, {"id": "2", "project_id": "q", "document_id": "z", "kind": "index", "state": "running", "created_utc": T0},
                                      {"id": "3", "project_id": "p", "document_id": "b", "kind": "refresh", "state": "failed", "created_utc": at(5), "expected_epoch": 1}, {"id": "4", "project_id": "p", "document_id": "b", "kind": "index", "state": "completed", "created_utc": at(1)},
                                      {"id": "5", "project_id": "p", "document_id": "c", "kind": "index", "state": "failed", "created_utc": at(1)}, {"id": "6", "project_id": "p", "document_id": "c", "kind": "index", "state": "queued", "created_utc": T0},
                                      {"id": "7", "project_id": "p", "document_id": "d", "kind": "index", "state": "failed", "created_utc": at(1)}])
    docs = rows(spark, "documents", [{"id": d, "project_id": "p", "path_key": d, "tombstoned": d == "d", "observation_epoch": 1} for d in "abcd"])
    revisions = rows(spark, "revisions", [{"id": "r1", "project_id": "p", "document_id": "a", "status": "staging"}, {"id": "r2", "project_id": "q", "document_id": "z", "status": "staging"}])
    paused, back, kept = S.set_paused(projects, jobs, revisions, "p", True)
    assert {r["id"]: r["state"] for r in back.collect()}["1"] == "queued" and [r["id"] for r in kept.collect()] == ["r2"]
    assert {r["id"] for r in S.runnable(back, paused).collect()} == {"2"}
    assert {r["state"] for r in S.set_paused(paused, back, kept, "p", False)[0].collect()} == {"active"}
    made = [r for r in S.retry_failed(docs, jobs, "p", now).collect() if r["id"] not in "1234567"]
    assert [(r["document_id"], r["kind"], r["state"]) for r in made] == [("b", "refresh", "queued")]
    d2, j2 = S.request_reindex(docs, jobs, "p", now)
    assert {r["id"]: r["observation_epoch"] for r in d2.collect()} == {"a": 2, "b": 2, "c": 2, "d": 1}
    assert {r["document_id"] for r in j2.where("kind = 'reindex' AND state <> 'failed'").collect()} == {"a", "b", "c"}


def test_renaming_excluding_and_hiding(spark):
    docs = rows(spark, "documents", [{"id": d, "project_id": "p", "path": d, "path_key": d, "file_name": d, "tombstoned": False, "observation_epoch": 1, "active_revision_id": "r"} for d in "abc"])
    moved = spark.createDataFrame([("p", "a", "n", "b", "n", ".x"), ("p", "c", "c", "c", "c", ".y")], "project_id string, old_key string, path string, path_key string, file_name string, extension string")
    got = {r["id"]: (r["path_key"], r["observation_epoch"], r["tombstoned"], r["active_revision_id"]) for r in S.rename(docs, moved).collect()}
    assert got == {"a": ("b", 2, False, "r"), "b": ("b", 2, True, None), "c": ("c", 2, False, "r")}
    x = S.exclude(S.exclude(rows(spark, "exclusions", []), "p", "/a/f", F.lit(at(1)).cast("timestamp")), "p", "/A/F", F.lit(at(2)).cast("timestamp"))
    assert [(r["path_key"], r["created_utc"]) for r in x.collect()] == [("/A/F", at(1))] and S.include(x, "p", "/a/f").count() == 0
    issues = spark.createDataFrame([("p", "s1"), ("p", "s1")], "project_id string, signature string")
    h = S.hide_issues(rows(spark, "acknowledgements", []), issues, F.lit(T0).cast("timestamp"))
    assert h.count() == 1 and S.restore_issues(h, issues).count() == 0


def test_refreshed_vectors_are_whole_or_refused(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "i"))
    docs = rows(spark, "documents", [{"id": "a", "project_id": "p", "path_key": "a", "tombstoned": False, "active_revision_id": "r"}])
    passages = rows(spark, "passages", [{"id": f"a{i}", "document_id": "a", "revision_id": "r", "project_id": "p", "semantic_eligible": i < 2} for i in range(3)])
    store.commit({"documents": docs, "passages": passages}, passages)
    v = rows(spark, "embeddings", [{"passage_id": f"a{i}", "document_id": "a", "revision_id": "r", "project_id": "p", "vector": [1.0, 0.0]} for i in range(2)])
    for bad in (v.limit(1), v.unionByName(v), v.withColumn("revision_id", F.lit("old"))):
        with pytest.raises(RequestError):
            S.commit_refresh(store, bad, "now", 2)
    assert S.commit_refresh(store, v, "now", 2) == 2 and store.read("embeddings").where("policy_key = 'now'").count() == 2


def test_prefixes_over_folders():
    assert S.authorised_prefixes(["sub/x", "/b/y"], ["/a", "/b"]) == ["/a/sub/x", "/b/sub/x", "/b/y"]
    for bad in (["/c"], ["../b"], ["x/../../y"]):
        with pytest.raises(RequestError):
            S.authorised_prefixes(bad, ["/a", "/b"])


def test_batches_by_length_and_memory():
    from strandex.operators.vectors import in_batches

    sizes = []

    def embed(texts):
        if len(texts) > 3:
            raise MemoryError
        sizes.append([len(t) for t in texts])
        return [len(t) for t in texts]

    texts = ["x" * n for n in (5, 1, 9, 3, 7, 2, 8)]
    assert in_batches(texts, embed, 16) == [5, 1, 9, 3, 7, 2, 8] and all(s == sorted(s, reverse=True) for s in sizes)
    with pytest.raises(MemoryError):
        in_batches(["a"], lambda t: (_ for _ in ()).throw(MemoryError()), 4)
