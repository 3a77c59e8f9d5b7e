import json

from pyspark.sql import functions as F

from stratadoc.operators import extract
from stratadoc.sources import readers


def block(y, spans, x1=500.0, kind=0):
    return {"type": kind, "bbox": [72.0, y, x1, y + 12], "lines": [{"spans": [{"text": t, "size": s, "font": f, "flags": g} for t, s, f, g in spans]}]}


PAGE = {
    "file": "a.pdf", "page": 1, "width": 612.0, "height": 792.0,
    "blocks": [
        block(30, [("Design Manual Page 5", 8.0, "Roman", 0)]),
        block(100, [("5.2 Drainage", 14.0, "Bold", 16), (" of roads ", 14.0, "Bold", 16)]),
        block(150, [("Bold callout in one line", 10.0, "Other", 16)], x1=400.0),
        block(180, [("Bold but narrow callout", 10.0, "Other", 16)], x1=200.0),
        block(200, [("Exhibit 5 shows the large type", 14.0, "Bold", 0)]),
        block(230, [("Plain text of a body.", 10.0, "Roman", 0), ("It has more sentences.", 10.0, "Roman", 0), ("x", 30.0, "Odd", 0)]),
        block(260, [("short", 10.0, "Roman", 0)]),
        block(300, [("an image", 10.0, "Roman", 0)], kind=1),
        block(760, [("Printed in 2020 by the state", 8.0, "Roman", 0)]),
    ],
}


def test_spans_become_classified_blocks(spark, tmp_path):
    (tmp_path / "pages.jsonl").write_text(json.dumps(PAGE) + "\n")
    styled = extract.styled_blocks(readers.page_spans(spark, str(tmp_path / "pages.jsonl")))
    rows = {r.text: r for r in extract.classified(styled).collect()}
    kinds = {t: r.kind for t, r in rows.items()}
    assert kinds == {
        "Design Manual Page 5": "header",
        "5.2 Drainage of roads": "heading",
        "Bold callout in one line": "heading",
        "Bold but narrow callout": "body",
        "Exhibit 5 shows the large type": "body",
        "Plain text of a body. It has more sentences. x": "body",
        "Printed in 2020 by the state": "footer",
    }
    body = rows["Plain text of a body. It has more sentences. x"]
    assert (body.font_size, body.font_name, body.bold) == (10.0, "Roman", False) and rows["5.2 Drainage of roads"].bold


def test_headings_in_odd_fonts_become_body(spark):
    rows = [("f", "heading", 14.0, n) for n in ["A", "A", "B", "B", "C", ""]] + [("f", "heading", 5.0, "D"), ("f", "body", 10.0, "Z"), ("g", "body", 10.0, "Q")]
    df = spark.createDataFrame(rows, "file string, kind string, font_size double, font_name string")
    got = {(r.file, r.font_name): r.kind for r in extract.consistent_headings(df).collect()}
    assert got == {("f", "A"): "heading", ("f", "B"): "heading", ("f", "C"): "body", ("f", ""): "heading", ("f", "D"): "body", ("f", "Z"): "body", ("g", "Q"): "body"}


def test_scanned_files(spark):
    rows = [("scan", i, "x" if i <= 30 else "y" * 60) for i in range(1, 41)] + [("text", i, "z" * 60) for i in range(1, 4)] + [("gaps", 1, None), ("gaps", 2, "z" * 60)]
    got = {r.source_file: (r.low_share, r.scanned) for r in extract.scanned_files(spark.createDataFrame(rows, "source_file string, page_no int, text string")).collect()}
    assert got == {"scan": (1.0, True), "text": (0.0, False), "gaps": (0.5, False)}


def test_a_page_without_sizes(spark):
    page = {**PAGE, "blocks": [block(300, [("No size is known here", 0.0, "Roman", 0)])]}
    df = spark.createDataFrame([(json.dumps(page),)], "v string").select(F.from_json("v", extract_schema()).alias("p")).select("p.*")
    row = extract.classified(extract.styled_blocks(df)).first()
    assert (row.page_size, row.font_size, row.kind) == (12.0, 0.0, "body")


def extract_schema():
    from stratadoc import schema

    return schema.SPAN_PAGE
