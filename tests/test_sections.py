import pytest
from pyspark.sql import functions as F

from stratadoc.functions import sections

NUMBERS = {
    "1926.502(b) Fall arrest": ("1926.502(b)", [("LEAD_INT", 1926), ("DOT_INT", 502), ("PAREN_ALPHA", 2)]),
    "6-02.3(25) Concrete": ("6-02.3(25)", [("LEAD_INT", 6), ("HYPHEN_INT", 2), ("DOT_INT", 3), ("PAREN_INT", 25)]),
    "(c) text": ("(c)", [("PAREN_ROMAN", 100)]),
    "12.4[iv] x": ("12.4[iv]", [("LEAD_INT", 12), ("DOT_INT", 4), ("BRACK_ROMAN", 4)]),
    "3.A": ("3.A", [("LEAD_INT", 3), ("DOT_ALPHA", 1)]),
    "555.1234567": (None, None),
    "5": (None, None),
    "Text 5.2": (None, None),
    "": (None, None),
    None: (None, None),
}


def test_numbers_and_segments(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "line string").withColumn("n", sections.number_text(F.col("line")))
    for r in df.withColumn("s", sections.segments_of(F.col("n"))).collect():
        number, segments = NUMBERS[r.line]
        assert r.n == number
        assert (segments is None and r.s is None) or [(s.type, s.int_val) for s in r.s] == segments


@pytest.mark.parametrize(
    "line, strict, relaxed",
    [
        ("1926.502(b) Guardrails", "1926.502(b)", "1926.502(b)"),
        ("39.37 inches", None, "39.37"),
        ("18.05 Works", None, "18.05"),
        ("12.4 Works", "12.4", "12.4"),
        ("1110-2-1902 Manual", None, None),
        ("5.2 Drainage", None, "5.2"),
        ("4.3.1 Drainage", "4.3.1", "4.3.1"),
        ("126.75 Level", None, "126.75"),
        ("1310.02(13) applies here", "1310.02(13)", "1310.02(13)"),
        ("1310.02 applies here", "1310.02", "1310.02"),
        ("1310.02 of the", None, "1310.02"),
        ("1999 Edition", None, None),
        ("2010.5 Edition", None, None),
        ("0123.4 x", None, None),
        ("9001.4 X", None, None),
        ("12.0 X", None, None),
        ("12.4 = X", None, None),
        ("12.4 55.2", None, None),
    ],
)
def test_candidates(spark, line, strict, relaxed):
    row = spark.createDataFrame([(line,)], "t string").select(sections.candidate(F.col("t")).alias("s"), sections.relaxed(F.col("t")).alias("r")).first()
    strict = None if line in ("1310.02(13) applies here", "1310.02 applies here") else strict  # a small letter follows
    assert (row.s, row.r) == (strict, relaxed)


def test_headings(spark):
    cases = {
        "Chapter 5 Drainage": "Chapter 5",
        "Part 12A General": "Part 12A",
        "5.2 Drainage": "5.2",
        "\n\nDrainage of bridges:  ": "Drainage of bridges",
        "x" * 60: "x" * 50,
        "": "UNKNOWN",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", sections.heading_label(F.col("t")).alias("l"))
    assert {r.t: r.l for r in df.collect()} == cases


def test_roman_values(spark):
    df = spark.createDataFrame([("iv",), ("XIII",), ("mcmxc",), ("d",)], "t string").select(sections.roman_value(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [4, 13, 1990, 500]


def seg(*parts):
    return [{"type": t, "value": v, "int_val": i, "raw": v} for t, v, i in parts]


def test_advances():
    lead = ("LEAD_INT", "1310", 1310)
    at = lambda n: seg(lead, ("DOT_INT", str(n), n))
    assert sections.advances(at(2), at(3)) and sections.advances(at(2), at(22))
    assert not sections.advances(at(2), at(23)) and not sections.advances(at(3), at(3))
    assert sections.advances(at(2), seg(lead, ("DOT_INT", "2", 2), ("PAREN_INT", "5", 5)))
    assert not sections.advances(at(2), seg(lead, ("DOT_INT", "2", 2), ("PAREN_INT", "6", 6)))
    assert sections.advances(seg(lead, ("DOT_INT", "2", 2), ("PAREN_INT", "5", 5)), at(3))
    assert sections.advances(at(2), seg(("LEAD_INT", "1311", 1311), ("DOT_INT", "1", 1)))
    assert not sections.advances(None, seg(("LEAD_INT", "12", 12), ("DOT_INT", "4", 4)))
    assert sections.advances(None, seg(("LEAD_INT", "12", 12), ("HYPHEN_INT", "4", 4)))


def test_section_values(spark):
    cases = {"1310.02(13)": True, "12": False, "A12": False, "12 4": False, "1" * 61: False, " 6-02 ": True}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", sections.is_section_value(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases
