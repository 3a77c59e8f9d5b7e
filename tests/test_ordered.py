import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stratadoc.operators import extract, ordered


def frame(spark, rows):
    return spark.createDataFrame(rows, "f string, i int, c string")


def test_forward_fill_across_spans(spark):
    random.seed(1)
    rows = [(f, i, random.choice(["UNKNOWN", "UNKNOWN", None, f"s{i}"])) for f in ("a", "b", None) for i in random.sample(range(60), 40)]
    got = {(r.f, r.i): r.c for r in ordered.forward_fill(frame(spark, rows), "f", "i", ["c"], span=7).collect()}
    last = {}
    for f, i, c in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        last[f] = c if c not in (None, "UNKNOWN") else last.get(f, "UNKNOWN")
        assert got[f, i] == last[f]


def test_lag_total_and_number_across_spans(spark):
    rows = [(f, i * 3 % 97, str(i)) for f in ("a", "b") for i in range(50)]
    df = frame(spark, rows).selectExpr("*", "i % 5 AS v")
    out = ordered.numbered(ordered.running_totals(ordered.lagged(df, "f", "i", "c", "p", span=10), "f", "i", {"v": "t"}, span=10), "f", ["i"], "n", (ordered.F.floor(ordered.F.col("i") / 10)))
    for f in ("a", "b"):
        mine = sorted((r for r in out.collect() if r.f == f), key=lambda r: r.i)
        assert [r.p for r in mine] == [None, *(r.c for r in mine[:-1])]
        assert [r.t for r in mine] == [sum(x.v for x in mine[: k + 1]) for k in range(len(mine))]
        assert [r.n for r in mine] == list(range(len(mine)))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert ordered.forward_fill(none, "f", "i", ["c"]).count() == 0
    assert ordered.word_windows(none, "f", "c").count() == 0
    assert ordered.distinct_lines(none, "f", "c").count() == 0


def test_last_writer_is_idempotent(spark):
    df = frame(spark, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("a", 2, "y")])
    once = ordered.last_writer(df, ["f"], ["i", "c"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ordered.last_writer(once, ["f"], ["i", "c"]).collect())) == [("a", 2, "y"), ("b", 1, "z")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 900))
def test_windows_hold_every_word_once_without_overlap(spark, n):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "k int, t string")
    pieces = [r.piece.split() for r in ordered.word_windows(df, "k", "t").orderBy("window").collect()]
    assert all(len(p) <= 220 for p in pieces)
    assert [w for k, p in enumerate(pieces) for w in (p if k == 0 else p[50:])] == [f"w{i}" for i in range(n)]


def test_tracker_follows_lines(spark):
    rows = [("a", 0, "intro\n\n1310.02 Scope\nx"), ("a", 1, "text\nmore\n1310.90 Other"), ("a", 2, "text\nmore\n1310.03 Next"), ("b", 0, "none")]
    got = {(r.f, r.i): r.section for r in ordered.tracked_sections(frame(spark, rows), "f", "i", "c").collect()}
    assert got == {("a", 0): "1310.02", ("a", 1): "1310.02", ("a", 2): "1310.03", ("b", 0): "UNKNOWN"}


def test_a_file_with_most_rows_is_followed_in_many_tasks(spark):
    rows, at = [], 1
    pick = random.Random(8)
    for i in range(4000):
        at += 1
        rows.append(("hot", i, pick.choice([f"1310.{at:02} Scope", "text", f"text\nmore\n1310.{at:02} Deep", "text\n\nx\n77.1 Odd"])))
    rows += [(f"f{k}", 0, "text") for k in range(40)]
    df = frame(spark, rows).repartition(4)
    tracked = ordered.tracked_sections(df, "f", "i", "c", span=500)
    got = {(r.f, r.i): r.section for r in tracked.collect()}
    one = {(r.f, r.i): r.section for r in ordered.tracked_sections(df.coalesce(1), "f", "i", "c").collect()}
    assert got == one and len(got) == 4040
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    busy = tracked.filter("f = 'hot'").groupBy(ordered.F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(busy) > 1


def plain_chunks(blocks, size=220, overlap=50):
    """The rules again, as a loop over one file."""
    out, words, label = [], [], None
    for head, body, section, page in blocks:
        new = body.split()
        if not new:
            continue
        if head:
            if len(words) >= 10:
                out.append((" ".join(words), *label))
            words = new
        else:
            if label and section != label[1] and "UNKNOWN" not in (section, label[1]):
                if len(words) >= 30:
                    out.append((" ".join(words), *label))
                words = []
            words = words + new
        label = (page, section)
        while not head and len(words) >= size:
            out.append((" ".join(words[:size]), *label))
            words = words[size - overlap :]
    if len(words) >= 30:
        out.append((" ".join(words), *label))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_against_a_loop(spark, seed):
    random.seed(seed)
    files = {}
    for f in range(12):
        files[f"f{f}"] = [
            (random.random() < 0.25, " ".join(f"w{random.randint(0, 99)}" for _ in range(random.choice([0, 3, 12, 40, 200, 260, 700]))), random.choice(["UNKNOWN", "1.1", "1.2", "1.2"]), i)
            for i in range(random.randint(0, 25))
        ]
    rows = [(f, i, "Heading " if b[0] else "body", b[1], b[2], str(b[3]), b[3]) for f, blocks in files.items() for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "source_file string, block_id bigint, kind string, text string, section string, doc_page string, page int")
    got = {(r.source_file, r.chunk_index): (r.text, r.page, r.section) for r in extract.chunked(df).collect()}
    assert got == {(f, i): c for f, blocks in files.items() for i, c in enumerate(plain_chunks(blocks))}


def test_two_inputs_in_one_session_stay_apart(spark):
    ddl = "source_file string, block_id bigint, kind string, text string, section string, doc_page string, page int"
    few = spark.createDataFrame([("a", 1, "body", "w " * 300, "1.1", "1", 1)], ddl)
    many = spark.createDataFrame([(f"b{i}", 1, "body", "w " * 300, "1.1", "1", 1) for i in range(20)], ddl)
    assert [extract.chunked(x).count() for x in (few, many, few)] == [2, 40, 2]


def test_running_labels(spark):
    rows = [
        ("a", 1, "header", "Page 3", 1), ("a", 2, "heading", "Introduction", 1), ("a", 3, "body", "some text here", 1), ("a", 4, "HEADING ", "5.2 Drainage", 1),
        ("a", 5, "heading", "Notes on it", 1), ("a", 6, "heading", "Page intentionally left blank", 1), ("a", 7, "body", "Drainage ............ 5", 1), ("a", 8, "footer", "no number", 1), ("a", 9, "body", "more", 1),
    ]
    df = spark.createDataFrame(rows, "source_file string, block_id bigint, kind string, text string, page int").selectExpr("*", "'x' AS doc_page", "'x' AS section")
    got = [(r.block_id, r.doc_page, r.section) for r in extract.with_running_labels(df, "source_file", "block_id").orderBy("block_id").collect()]
    assert got == [(2, "3", "Introduction"), (3, "3", "Introduction"), (4, "3", "5.2"), (5, "3", "5.2"), (9, "3", "5.2")]
