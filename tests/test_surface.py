import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from stratadoc import __main__ as cli
from stratadoc import serve
from stratadoc.operators import models, search
from stratadoc.plans.engine import Engine
from stratadoc.sources import readers
from tests.test_engine import blocks


@pytest.fixture
def filled(spark, tmp_path):
    root = tmp_path / "docs"
    for path in ("STATE/WA/wsdot/a.pdf", "LOCAL/WA/king county/b.pdf", "odd/c.pdf"):
        (root / path).parent.mkdir(parents=True)
        (root / path).write_bytes(b"x")
    (root / "STATE/WA/wsdot/links.json").write_text(json.dumps({"a.pdf": "http://x"}))
    blocks(spark).unionByName(blocks(spark, "b.pdf")).write.parquet(str(tmp_path / "blocks"))
    return tmp_path


def test_command_line(spark, filled):
    folder, said = str(filled / "engine"), []
    call = lambda *a, ask=lambda _: "n": cli.run(cli.arguments([folder, *a]), spark, ask, said.append)
    assert call("ingest", str(filled / "blocks"), str(filled / "docs"), "--dry-run") == 0 and any("Drainage" in x for x in said)
    assert call("ingest", str(filled / "blocks"), str(filled / "docs"), "--only", "STATE") == 0
    engine = Engine(spark, folder)
    assert {r.source_file for r in engine.chunks().collect()} == {"a.pdf"} and engine.catalogue().first().file_link == "http://x"
    assert call("ingest", str(filled / "blocks"), str(filled / "docs"), "--force") == 1
    assert call("ingest", str(filled / "blocks"), str(filled / "docs"), "--force", ask=lambda _: "Y") == 0
    assert engine.chunks().count() == 6
    before = engine._text_index()
    call("index")
    assert before is None and engine._text_index().count() > 0
    said.clear()
    call("query", "Who", "shall", "inspect", "a", "culvert", "1926.503")
    assert "culvert" in said[0]
    call("compact")
    assert engine._text_index() is None and engine.chunks().count() == 6  # the index is of the state before
    assert call("reset") == 1 and call("reset", ask=lambda _: "Y") == 0 and engine.chunks().count() == 0


def test_http(spark, filled):
    engine = Engine(spark, str(filled / "engine"))
    engine.ingest(spark.read.parquet(str(filled / "blocks")), cli.files_under(spark, str(filled / "docs")))
    (filled / "static").mkdir()
    (filled / "static" / "index.html").write_text("hello")
    running = serve.server(serve.Service(engine, "secret", str(filled / "static"), distance=4.0), port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()

    def call(path, body=None, **headers):
        request = urllib.request.Request(f"http://127.0.0.1:{running.server_port}{path}", None if body is None else json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request) as response:
                return response.status, response.read().decode()
        except urllib.error.HTTPError as error:
            return error.code, error.read().decode()

    try:
        assert json.loads(call("/health")[1])["chunks"] == 6 and json.loads(call("/smoke")[1])["ok"]
        assert "environment" in json.loads(call("/config")[1]) and json.loads(call("/filters")[1])["states"] == [{"state": "WA"}]
        assert len(json.loads(call("/standards/list")[1])) == 2 and "<li>a</li>" in call("/standards")[1]
        assert "culvert" in json.loads(call("/query", {"query": "Who shall inspect a culvert?", "filter_agency": "WSDOT"})[1])["answer"]
        assert call("/query", {"query": " "})[0] == 422 and call("/nowhere", {})[0] == 404 and call("/../x")[0] == 404 and call("/")[1] == "hello"
        lines = [json.loads(x[5:]) for x in call("/query/stream", {"query": "Who shall inspect a culvert?"})[1].split("\n") if x]
        assert [e["type"] for e in lines][0] == "meta" and [e["type"] for e in lines][-1] == "done" and "source_block" in [e["type"] for e in lines]
        one = {"corrections": [{"source_file": "a.pdf", "page": 1, "chunk_index": 0, "section": "7-77.7"}]}
        assert call("/correct", one)[0] == 403 and json.loads(call("/correct", one, **{"x-token": "secret"})[1]) == {"received": 1, "refused": 0}
        assert engine.chunks().filter("section = '7-77.7'").count() == 1
        assert call("/request", {"document": ""})[0] == 422 and call("/request", {"document": "Manual"})[0] == 200
        assert call("/analytics/event", {"kind": "query", "key": "all"})[0] == 200
        assert json.loads(call("/analytics")[1])["totals"]["total"] == 1 and "<table>" in call("/analytics", accept="text/html")[1]
    finally:
        running.shutdown()


def test_limited_requests_are_logged(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    rows = spark.range(25).selectExpr("id AS request_id", "'c' AS client", "timestamp_seconds(1735689600 + id) AS ts")
    assert engine.admitted(rows).count() == 20
    assert spark.read.text(str(tmp_path / "e/rate_limited")).count() == 5


def test_calls_are_tried_again():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert models.tried(call, sleep=waits.append) == "ok" and waits == [2.0, 2.0]
    with pytest.raises(OSError):
        models.tried(lambda: (_ for _ in ()).throw(OSError("down")), sleep=waits.append)
    assert len(waits) == 4 and "^^^FAIL^^^" in models.payload("m", "q", "c")["system"]


def test_models_behind_services(spark):
    def embed(host, text):
        if len(text.split()) > 160:
            raise models.TooLong
        if "bad" in text:
            raise OSError("down")
        return [float(len(text.split())), 1.0]

    df = spark.createDataFrame([("a", "w " * 200), ("b", "w w"), ("c", "bad"), ("d", None)], "id string, text string")
    got = {r.id: r.vector for r in models.embedder(embed, ["x", "y"], wait=0)(df, "text").collect()}
    assert got == {"a": [150.0, 1.0], "b": [2.0, 1.0], "c": None, "d": None}
    asked = spark.createDataFrame([(1, "q", "p"), (2, "bad", "p")], "query_id int, query string, prompt string")
    said = {r.query_id: (r.answer, r.message) for r in models.answered(asked, lambda host, x: "- A.\n^^^1^^^" if "bad" not in x["prompt"] else 1 / 0, ["x"], "m", wait=0).collect()}
    assert said == {1: ("- A.\n^^^1^^^", None), 2: (None, "division by zero")}
    assert search.FACETS


def test_pages_of_files_become_chunks(spark, tmp_path):
    def read(content):
        name = content.decode()
        if name == "broken":
            raise ValueError(name)
        span = lambda t, size, bold=0: {"spans": [{"text": t, "size": size, "font": "Roman", "flags": 16 * bold}]}
        block = lambda y, *lines: {"type": 0, "bbox": [50.0, y, 550.0, y + 20], "lines": list(lines)}
        body = [span(f"Every culvert of the {name} shall be inspected before each shift.", 10.0) for _ in range(40)]
        return [{"page": p, "width": 612.0, "height": 792.0, "blocks": [block(100.0, span("5.2 Drainage of the road", 16.0, 1)), block(300.0, *body), block(760.0, span(f"Manual of works Page {p}", 8.0))]} for p in (1, 2)]

    (tmp_path / "STATE/WA/wsdot").mkdir(parents=True)
    for name, content in (("a.pdf", "road"), ("b.pdf", "broken")):
        (tmp_path / "STATE/WA/wsdot" / name).write_text(content)
    engine = Engine(spark, str(tmp_path / "engine"))
    blocks_found = engine.blocks_of(readers.parsed_pages(spark, str(tmp_path), read))
    assert {(r.page, r.kind) for r in blocks_found.collect()} == {(p, k) for p in (1, 2) for k in ("heading", "body", "footer")}
    engine.ingest(blocks_found, cli.files_under(spark, str(tmp_path)))
    got = engine.chunks().collect()
    assert {(r.source_file, r.section, r.agency) for r in got} == {("a.pdf", "5.2", "WSDOT")} and len(got) == 6
    assert engine.lookup(got[0].id).count() == 1
    engine.remove(F.col("page") == 2)
    assert {r.page for r in engine.chunks().collect()} == {1}


def test_recognition_falls_back(spark):
    pages = spark.createDataFrame([(1, b"x"), (2, b"y"), (3, None), (4, b"z")], "page int, image binary")
    call = lambda image, mode: "long enough a text " * 5 if image == b"x" else 1 / 0 if image == b"z" else mode
    assert {r.page: r.text and r.text[:5] for r in models.recognised(pages, call).collect()} == {1: "long ", 2: "block", 3: None, 4: None}
