import json

import numpy as np
import pytest

from stratadoc import config, schema, session
from stratadoc.operators import catalogue_views, cells, context, evaluation, search, upkeep, usage
from stratadoc.sources import readers
from pyspark.sql import functions as F


def test_versions_are_published_whole(spark, tmp_path):
    t = upkeep.VersionedTable(spark, str(tmp_path / "t"))
    assert not t.exists()
    assert t.open_or_create(schema.CHUNK).count() == 0
    t.publish(upkeep.replaced(t.read(), spark.createDataFrame([("f", "a")], "source_file string, text string")))
    t.publish(upkeep.replaced(t.read(), spark.createDataFrame([("f", "b"), ("g", "c")], "source_file string, text string")))
    assert sorted((r.source_file, r.text) for r in t.read().collect()) == [("f", "b"), ("g", "c")]
    t.publish(upkeep.without(t.read(), F.col("source_file") == "f"))
    assert [r.text for r in t.read().collect()] == ["c"]


def test_a_lost_race_raises(spark, tmp_path):
    t = upkeep.VersionedTable(spark, str(tmp_path / "t"))
    t.publish(spark.range(1))
    other = upkeep.VersionedTable(spark, str(tmp_path / "t"))
    number = other._live()
    other._live = lambda: number
    t.publish(spark.range(2))
    with pytest.raises(RuntimeError):
        other.publish(spark.range(3))
    assert t.read().count() == 2


def test_changes_write_only_their_own_rows(spark, tmp_path):
    t = upkeep.VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(r, "id string, source_file string, section string, flag boolean")
    t.publish(rows(*((f"f__{i}", "f", "1", False) for i in range(500))))
    size = lambda: {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "t").iterdir() if p.name != "_live"}
    before = size()
    t.append(rows(("g__0", "g", "1", False), ("g__1", "g", "1", False)))
    t.update(spark.createDataFrame([("f__3", "9.9", True)], "id string, section string, flag boolean"))
    t.update(spark.createDataFrame([("f__3", None, True), ("f__4", "8.8", True)], "id string, section string, flag boolean"))
    t.replace(rows(("g__0", "g", "2", False)))
    assert sorted(size().values()) == sorted([*before.values(), 2, 1, 2, 1, 1])
    seen = sorted(map(tuple, t.read().collect()))
    assert len(seen) == 501 and ("f__3", "f", "9.9", True) in seen and ("f__4", "f", "8.8", True) in seen and ("g__0", "g", "2", False) in seen
    t.compact()
    assert sorted(map(tuple, t.read().collect())) == seen and len(t._live()[1]) == 1
    assert t.reset("id string").count() == 0


def test_missing_columns_and_failures(spark):
    df = schema.with_missing_columns(spark.createDataFrame([("a b", None), ("c", [1.0])], "text string, vector array<float>"))
    assert set(schema.T.StructType.fromDDL(schema.CHUNK).names) == set(df.columns)
    kept, failed = upkeep.split_failures(df)
    assert kept.count() == 1 and failed.first()[1:4] == (2, 3, "a b")


def test_corrections(spark):
    chunks = spark.createDataFrame([("f__p1__c0", "1.1", "1", False, False), ("f__p1__c1", "1.1", "1", True, False)], "id string, section string, doc_page string, llm_corrected_section boolean, llm_corrected_doc_page boolean")
    log = [("f", 1, 0, "1.1", "2.2", "section", None, 1), ("f", 1, 0, "2.2", "3.3", "section", None, 2), ("f", 1, 0, "", None, None, "4.4", 3), ("f", 1, 1, "", "UNKNOWN", "doc_page", None, 4), ("f", 1, 1, "", "9", "doc_page", None, 1), ("f", 1, 1, "", "x", "agency", None, 9)]
    log = spark.createDataFrame(log, "source_file string, page int, chunk_index int, old_value string, correct_value string, field string, correct_section string, logged_at int")
    got = {r.id: tuple(r)[1:] for r in upkeep.corrected(chunks, log).select("id", "section", "doc_page", "llm_corrected_section", "llm_corrected_doc_page").collect()}
    assert got == {"f__p1__c0": ("4.4", "1", True, False), "f__p1__c1": ("1.1", "9", True, True)}


def test_link_files(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "FEDERAL/USA/OSHA").mkdir(parents=True)
    (root / "FEDERAL/USA/OSHA/links.json").write_text(json.dumps({"a.pdf": "from-links", "b.pdf": ""}))
    (root / "FEDERAL/USA/OSHA/_links.json").write_text("broken")
    (root / "_registry.json").write_text(json.dumps({"FEDERAL/USA/OSHA/b.pdf": "from-registry"}))
    for name in ("FEDERAL/USA/OSHA/a.pdf", "FEDERAL/USA/OSHA/b.pdf", "other.pdf"):
        (root / name).write_bytes(b"x")
    files = readers.documents_under(spark, str(root))
    links = {r.path: r.file_link for r in upkeep.links(files, readers.link_entries(spark, str(root))).collect()}
    assert links == {"FEDERAL/USA/OSHA/a.pdf": "from-links", "FEDERAL/USA/OSHA/b.pdf": "from-registry", "other.pdf": ""}
    assert [r.path for r in readers.misplaced(files).collect()] == ["other.pdf"]
    assert readers.documents_under(spark, str(root), "FEDERAL/USA").count() == 2


def test_logs_tolerate_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"source_file": "f", "page": 1, "chunk_index": 0, "correct_section": "2.2", "timestamp": "2025-01-01T00:00:00"}\n\nnot json\n')
    rows = readers.correction_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert len(rows) == 1 and rows[0].field is None and rows[0].correct_section == "2.2"


def test_event_lines_round_trip(spark):
    events = spark.createDataFrame([("s", 0, "text", "a", None, None, None), ("s", 1, "source_block", None, 2, None, None)], f"stream_id string, seq int, {schema.EVENT}")
    lines = readers.sse_lines(events).unionByName(spark.createDataFrame([("s", 9, ": ping")], "stream_id string, seq int, value string"))
    assert sorted((r.seq, r.type, r.n) for r in readers.sse_events(lines).collect()) == [(0, "text", None), (1, "source_block", 2)]


def test_fusion_keeps_the_last_payload(spark):
    rows = [(0, 0, 1.0, "a", 0.1), (0, 1, 1.0, "b", 0.2), (1, 0, 1.0, "b", -1.0), (2, 0, 0.5, "a", 0.3)]
    got = search.fused(spark.createDataFrame(rows, "list_id int, rank int, weight double, id string, distance double"), "id").orderBy("place").collect()
    assert [(r.id, r.distance) for r in got] == [("b", -1.0), ("a", 0.3)]


def test_cut_after_limit_and_facets(spark):
    df = spark.createDataFrame([(i, [float(i)], "A" if i % 2 else "B") for i in range(6)], "vec_id int, embedding array<float>, agency string")
    assert [r.vec_id for r in search.nearest(df, [0.0], 3, most=1.0).collect()] == [0, 1]
    assert search.facet_filter(df, agency="A", state="").count() == 3
    asked = spark.createDataFrame([(9, [0.0], "A"), (8, [5.0], "")], "q int, embedding array<float>, filter_agency string")
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.nearest_to_each(df, asked, 2, query_id="q", facets=("agency",)).collect()}
    assert got == {(9, 1): 1, (9, 2): 3, (8, 1): 5, (8, 2): 4}


def test_rerank_floor_after_top(spark):
    hits = spark.createDataFrame([(1, 0, "a b", "a x"), (1, 1, "a b", "a b"), (1, 2, "a b", "none")], "query_id int, place int, query string, text string")
    assert [(r.place, r.rerank_place) for r in search.reranked(hits, "query", "text").orderBy("rerank_place").collect()] == [(1, 0), (0, 1)]


def test_context(spark):
    chunks = spark.createDataFrame([("f", "1.1", i, f"text number {i} of it") for i in range(5)] + [("f", "2.2", 5, "other")], "source_file string, section string, chunk_index int, text string")
    hits = spark.createDataFrame([(1, 0, "f", "1.1", 1, "text number 1 of it", "7", False), (1, 1, "f", "2.2", 5, "other", "8", True), (1, 2, "f", "1.1", 4, "text number 4 of it", "9", False)], "query_id int, place int, source_file string, section string, chunk_index int, text string, doc_page string, llm_corrected_section boolean")
    sources = context.grouped(context.expanded(hits, chunks)).orderBy("idx").collect()
    assert [(r.idx, r.places) for r in sources] == [(1, [0, 2]), (2, [1])]
    assert sources[0].context.startswith("text number 0 of it text number 1 of it")
    prompt = context.prompts(context.grouped(context.expanded(hits, chunks))).first().prompt
    assert "[SRC_2] Document: f 2.2 [llm corrected], page 8\n---" in prompt


def test_usage(spark):
    events = spark.createDataFrame([("a", "2025-01-01 10:00:00", i) for i in range(3)] + [("b", "2025-01-01 10:00:00", i) for i in range(3)], "client string, ts string, k int").withColumn("ts", F.to_timestamp("ts"))
    allowed = {(r.client, r.k): r.allowed for r in usage.within_quota(events, "client", "ts", "k", 2, ("b",)).collect()}
    assert allowed == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("b", 0): True, ("b", 1): True, ("b", 2): True}
    counts = spark.createDataFrame([("2025-01-30", 5), ("2025-01-01", 1)], "day string, n bigint")
    last = F.to_date(F.lit("2025-01-30"))
    assert usage.series(counts, last).count() == 30 and usage.totals(counts, last).first()[:2] == (5, 6)
    assert usage.net_counts(spark.createDataFrame([("f", 1), ("f", -1), ("f", -1)], "f string, delta int"), ["f"]).first().n == 0


def test_evaluation(spark):
    results = spark.createDataFrame([(1, "OK", ["A"], "^^^1^^^"), (2, "FAIL", [], "^^^FAIL^^^"), (3, "OK", ["X"], "^^^1^^^^^^FAIL^^^"), (4, "OK", ["X"], "")], "n int, status string, agencies array<string>, response string")
    expected = spark.createDataFrame([(1, "OK", ["A", "B"]), (2, "FAIL", []), (3, "OK", ["A"])], "n int, expected_status string, expected_agencies array<string>")
    got = evaluation.judged(results, expected)
    assert {r.n: (r.correct, r.spurious_fail) for r in got.collect()} == {1: (True, False), 2: (True, False), 3: (False, True), 4: (False, False)}
    before = spark.createDataFrame([(1, False), (3, True)], "n int, correct boolean")
    assert {r.n: r.change for r in evaluation.compared(got, before).collect()} == {1: "improved", 2: "improved", 3: "regressed"}


def test_requests_and_config(spark):
    df = spark.createDataFrame([(5, 0, "x"), (-1, 100_000, "y" * 201)], "page int, chunk_index int, document string")
    assert [r.problems for r in schema.request_problems(df).collect()] == [[], ["page", "chunk_index", "document"]]
    c = config.load({"STRATADOC_ENV": " Prod ", "STRATADOC_MODEL_HOSTS": "http://a/, http://b"})
    assert c.environment == "production" and [c.host(i) for i in range(3)] == ["http://a", "http://b", "http://a"]


def test_plans_read_only_what_they_need(spark, tmp_path):
    spark.createDataFrame([("i", "f", "A", "STATE", "WA", "", "", [1.0])], "id string, source_file string, agency string, jurisdiction string, state string, locality string, file_link string, vector array<float>").write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    plan = catalogue_views.catalogue(df)._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan
    plan = search.facet_filter(df, agency="A")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(agency,A)" in plan


def test_vectors_of_several_lengths(spark):
    rows = [(i, [float(i), 0.0]) for i in range(30)] + [(100 + i, [float(i), 0.0, 0.0]) for i in range(5)] + [(200, None), (201, []), (202, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(3)
    got = search.nearest_to_each(df, df.filter("vec_id in (3, 101, 200)"), 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(3, 1, 2), (3, 2, 4), (101, 1, 100), (101, 2, 102)]


def test_blocks_of_queries_give_the_same(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.integers(0, 3, 4).astype(float).tolist(), "ab"[i % 2]) for i in range(300)], "vec_id int, embedding array<float>, state string")
    asked = df.filter("vec_id % 4 = 0").withColumn("filter_state", F.when(F.col("vec_id") % 8 == 0, "a").otherwise("")).drop("state").withColumnRenamed("vec_id", "q")
    one, many = (sorted(map(tuple, search.nearest_to_each(df, asked, 3, "embedding", "vec_id", "q", ("state",), block).collect())) for block in (4096, 10))
    assert one == many and len(one) == 225 and all(v % 2 == 0 for q, v, *_ in one if q % 8 == 0)


def test_rows_are_not_dealt_out_for_each_block_of_queries(spark, monkeypatch):
    """More queries than a block: every step of rows and products keeps the exact neighbours, and rows are read where they are."""
    monkeypatch.setattr(search, "STEP_NUMBERS", 600)
    monkeypatch.setattr(search, "STEP_PRODUCTS", 500)
    monkeypatch.setattr(search, "MANY_QUERIES", 5)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 6)), np.repeat(rng.normal(size=(20, 6)), 10, axis=0) * 1e-3, np.zeros((5, 6))]).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<float>").repartition(3)
    found = search.nearest_to_each(df, df, 4, block=200)
    apart = ((x[:, None].astype(float) - x) ** 2).sum(2)
    np.fill_diagonal(apart, np.inf)
    want = {(f"v{q:03}", f"v{v:03}", r + 1) for q in range(len(x)) for r, v in enumerate(np.lexsort((np.arange(len(x)), apart[q]))[:4])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == want
    assert "CoGroup" not in found._jdf.queryExecution().toString()


def test_full_text_within_facets(spark):
    texts = spark.createDataFrame([("a", "wall wall pipe", "EPA"), ("b", "wall", "OSHA"), ("c", "pipe", "OSHA")], "id string, text string, agency string")
    asked = spark.createDataFrame([(1, "wall", "OSHA"), (2, "wall", "")], "query_id int, query string, filter_agency string")
    got = search.bm25(search.postings(texts, "id", "text", ("agency",)), asked, "id", 5, facets=("agency",)).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(1, "b"), (2, "a"), (2, "b")]


def test_full_text_of_texts_is_that_of_their_index(spark):
    """No postings are written; the scores, ties and facets are those by the index, in one block of queries or several."""
    rng = np.random.default_rng(4)
    rows = [(f"t{i:03}", " ".join(f"W{min(int(w), 40)}" for w in rng.zipf(1.4, rng.integers(0, 9))), ("EPA", "OSHA", None)[i % 3]) for i in range(400)] + [("null", None, "EPA")]
    texts = spark.createDataFrame(rows, "id string, text string, agency string").repartition(3)
    asked = spark.createDataFrame([(i, f"w{1 + i % 9} w{1 + i % 4}, W{20 + i} none", ("", "EPA")[i % 2]) for i in range(25)] + [(90, "none", ""), (91, None, "")], "query_id int, query string, filter_agency string")
    exact = sorted(map(tuple, search.bm25(search.postings(texts, "id", "text", ("agency",)), asked, "id", 7, facets=("agency",)).collect()))
    for block in (4096, 10):
        found = search.bm25_texts(texts, asked, "id", 7, facets=("agency",), block=block)
        got = sorted(map(tuple, found.collect()))
        assert len(got) == 175 and got == exact
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_packed_rows_are_the_rows_in_less_room(spark):
    rows = [(i, None if i % 7 == 0 else [float(i % 3 == 0)] * 200, "pipe and wall " * 20) for i in range(2500)]
    df = spark.createDataFrame(rows, "id int, vector array<float>, text string")
    packed = session.Packed(df, 900)
    assert sorted(map(tuple, packed.rows().collect())) == rows
    assert packed.rows("text", "id").columns == ["text", "id"] and packed.rows("id").agg(F.sum("id")).first()[0] == 2500 * 2499 // 2
    assert packed.batches.agg(F.sum(F.length("batch"))).first()[0] < 2500 * 100
    more = df.union(spark.createDataFrame([(2500, [], None)], df.schema))
    assert sorted(session.Packed(session.squeezed(more, "vector"), 900, "vector").rows().collect()) == sorted(more.collect())


def test_quota_of_a_client_with_most_events(spark):
    rows = [(i, "hot" if i % 3 else f"c{i % 7}", f"2025-01-0{1 + i % 2} 10:00:{i % 60:02}") for i in range(900)] + [(901, None, None), (902, "hot", None)]
    df = spark.createDataFrame(rows, "event_id int, client string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: r.allowed for r in usage.within_quota(df, "client", "ts", "event_id", 4, ("c1",)).collect()}
    by = {}
    for i, c, t in sorted(rows, key=lambda r: (r[2] or "", r[0])):
        by.setdefault((c, (t or "")[:10]), []).append(i)
    assert got == {i: c == "c1" or i in by[c, (t or "")[:10]][:4] for i, c, t in rows}


def test_recall_of_cells(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 60)
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(30, 16))
    rows = [(f"v{i:04}", (middle[0 if i % 3 == 0 else i % 30] + 0.5 * rng.normal(size=16)).tolist(), "ab"[i % 2]) for i in range(3000)]
    rows += [("null", None, "a"), ("empty", [], "a"), ("short", [1.0, 2.0], "a"), ("short2", [1.0, 2.5], None)]
    df = spark.createDataFrame(rows, "id string, vector array<float>, state string")
    index = cells.CellIndex(df, facets=("state",))
    asked = df.filter("id like '%0' or id = 'short'").select(F.col("id").alias("q"), "vector", F.lit("a").alias("filter_state"))
    got, exact = ({(r.query_id, r.id) for r in x.collect()} for x in (index.search(asked, 5, query_id="q"), search.nearest_to_each(df, asked, 5, "vector", "id", "q", ("state",))))
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact) and ("short", "short") in got
    assert index.rows.groupBy("_cell", "_part").count().agg(F.max("count")).first()[0] < 200
    assert cells.CellIndex(df.limit(0)).search(df.limit(0), 3).count() == 0
