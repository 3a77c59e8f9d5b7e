import pytest

from stratadoc.plans.engine import Engine


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "engine"), log_queries=True)


def blocks(spark, name="a.pdf"):
    rows = [(1, "header", "Page 7"), (2, "heading", "5.2 Drainage of the road"), (3, "body", "Every culvert shall be inspected before each shift by a qualified crew. " * 30), (4, "heading", "5.3 Lighting"), (5, "body", "The lamp posts must be painted each year along both edges of the street. " * 5)]
    return spark.createDataFrame([(i, name, t, k, 1) for i, k, t in rows], "block_id bigint, source_file string, text string, kind string, page int")


def test_a_life_of_a_table(spark, engine):
    files = spark.createDataFrame([("STATE/WA/wsdot/a.pdf", "http://x"), ("LOCAL/WA/king county/b.pdf", "")], "path string, file_link string")
    engine.ingest(blocks(spark), files)
    first = {(r.chunk_index, r.section, r.doc_page, r.agency, r.state) for r in engine.chunks().collect()}
    assert first == {(0, "5.2", "7", "WSDOT", "WA"), (1, "5.2", "7", "WSDOT", "WA"), (2, "5.3", "7", "WSDOT", "WA")}
    engine.ingest(blocks(spark).unionByName(blocks(spark, "b.pdf")), files)
    assert engine.health()["chunks"] == 6
    engine.ingest(blocks(spark), files, force=True)
    assert engine.health()["chunks"] == 6
    assert [a["agency"] for a in engine.facets()["agencies"]] == ["KING COUNTY", "WSDOT"] and engine.facets() is engine.facets()
    asked = spark.createDataFrame([(1, "Who shall inspect a culvert before each shift?", "WSDOT"), (2, "zzz qqq", "NONE")], "query_id int, query string, filter_agency string")
    got = {r.query_id: r for r in engine.answer(asked, distance=4.0).collect()}
    assert "culvert" in got[1].answer and "^^^1^^^" in got[1].answer and got[2].answer == "^^^FAIL^^^"
    assert "a.pdf 5.2" in got[1].prompt
    assert {e.type for e in engine.events(engine.answer(asked, distance=4.0)).collect()} >= {"source_block", "fail", "done"}
    bad = engine.correct(spark.createDataFrame([("a.pdf", 1, 0, "9-99.9"), ("a.pdf", -1, 0, "9-99.9")], "source_file string, page int, chunk_index int, section string"))
    assert bad.count() == 1
    assert {r.section for r in engine.chunks().filter("id = 'a.pdf__p1__c0'").collect()} == {"9-99.9"}
    stale = engine.retag(files.limit(1))
    assert [r.source_file for r in stale.collect()] == ["b.pdf"]
    row = engine.chunks().filter("id = 'a.pdf__p1__c0'").first()
    assert row.section == "9-99.9" and row.llm_corrected_section and engine.chunks().count() == 6
    assert engine.catalogue().count() == 2


def test_usage_and_requests(spark, engine):
    engine.record(spark.createDataFrame([("query", "all", "c", "t", 1), ("query", "all", "c", "t", 1), ("query", "all", "c", "t", -1), ("odd", "x", "c", "t", 1)], "kind string, key string, client string, ts string, delta int"))
    assert [tuple(r) for r in engine.usage().collect()] == [("query", "all", 1)]
    rest = engine.request_document(spark.createDataFrame([("Manual", "n", "e"), (" ", "n", "e"), ("x" * 201, "n", "e")], "document string, notes string, email string"))
    assert rest.count() == 2


def test_nothing_is_an_answer_too(spark, engine):
    assert engine.chunks().count() == 0 and engine.facets() == {"agencies": [], "states": [], "localities": [], "scopes": []}
