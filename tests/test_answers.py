import random


import pytest

from stratadoc.operators import answers
from stratadoc.streaming import live


def events(text, size=3):
    state, out = answers.State(), []
    for i in range(0, len(text), size):
        state, new = answers.advance(state, text[i : i + size])
        out += new
    return out + answers.finish(state)


def test_places_and_tokens_agree():
    pick = random.Random(4)
    pieces = ["word ", "\n", "^^^3^^^", "^^^FAIL^^^", "\n^^^12^^^\n", "^^", "x" * 40, "A longer sentence of the answer stands here. ", "<think>a\nb</think>", " "]
    for _ in range(3000):
        text = "".join(pick.choice(pieces) for _ in range(pick.randint(0, 14)))
        for size in (1, 3, 4, 7, 30):
            assert answers.events_of(text, size) == events(text, size), (text, size)


def test_citations_and_fail():
    got = events("- One.\n^^^1^^^\n- Two.\n^^^2^^^\n^^^FAIL^^^")
    assert [(e["type"], e.get("n")) for e in got if e["type"] != "text"] == [("source_block", 1), ("source_block", 2), ("done", None)]
    assert [e["type"] for e in events("^^^FAIL^^^")] == ["fail", "done"]


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_no_marker_is_lost_whatever_the_token_size(size):
    text = "".join(f"- Line {i} of the answer.\n^^^{i}^^^\n" for i in range(1, 6))
    if size == 100:
        size = 30  # one marker is looked for after each token
    assert [e["n"] for e in events(text, size) if e["type"] == "source_block"] == [1, 2, 3, 4, 5]


def test_long_lines_are_sent_before_they_end():
    state, sent = answers.State(), []
    for _ in range(40):
        state, new = answers.advance(state, "word ")
        sent += new
    assert sent and all(e["type"] == "text" for e in sent)


def test_answers_come_back(spark):
    df = spark.createDataFrame([(1, "- One.\n^^^1^^^"), (2, None), (3, ""), (4, "^^^FAIL^^^")], "k int, r string")
    parsed = answers.parsed(df, "k", "r")
    back = {r.k: r.response for r in answers.rebuilt(parsed, "k").collect()}
    assert back == {1: "- One.\n^^^1^^^", 2: "", 3: "", 4: "^^^FAIL^^^"}


def test_meta_and_error_events(spark):
    parsed = answers.parsed(spark.createDataFrame([(1, "- One.\n^^^1^^^"), (2, "- Two.")], "k int, r string"), "k", "r")
    sources = spark.createDataFrame([(1, 2, "b.pdf"), (1, 1, "a.pdf")], "k int, idx int, source_file string")
    failed = spark.createDataFrame([(2, "no model")], "k int, message string")
    got = sorted(answers.framed(parsed, "k", sources, failed).collect(), key=lambda r: (r.k, r.seq))
    assert [(r.k, r.type) for r in got] == [(1, "meta"), (1, "text"), (1, "source_block"), (1, "done"), (2, "error")]
    assert got[0].message == '[{"idx":1,"source_file":"a.pdf"},{"idx":2,"source_file":"b.pdf"}]' and got[-1].message == "no model"
    assert {r.k: r.response for r in answers.rebuilt(answers.framed(parsed, "k", sources, failed), "k").collect()}[2] == "^^^FAIL^^^"


def run(query):
    """All that is there now."""
    started = query.trigger(availableNow=True).start()
    try:
        assert started.awaitTermination(40)
    finally:
        started.stop()


def test_streamed_tokens(spark, tmp_path):
    text = "- One.\n^^^1^^^\n- Two.\n^^^2^^^"
    rows = [("s", i, text[i : i + 4], i + 4 >= len(text)) for i in range(0, len(text), 4)]
    ddl = "session string, at bigint, token string, done boolean"
    timed = lambda part: spark.createDataFrame(part, ddl).selectExpr("*", "timestamp_millis(1735689600000 + at) AS ts").coalesce(1)
    for k in (0, 4):
        timed(rows[:4] if k == 0 else rows[4:]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{ddl}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(live.parse_tokens(stream).writeStream.format("memory").queryName("parsed_tokens").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    got = sorted(spark.table("parsed_tokens").collect(), key=lambda r: r.seq)
    assert [r.n for r in got if r.type == "source_block"] == [1, 2] and got[-1].type == "done"
    assert [r.seq for r in got] == list(range(len(got)))


def test_streamed_quota(spark, tmp_path):
    df = spark.createDataFrame([("a", "2025-01-01 10:00:00")] * 3 + [("b", "2025-01-01 11:00:00")], "client string, ts string").selectExpr("client", "to_timestamp(ts) AS ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(live.admitted(stream, 2).writeStream.format("memory").queryName("quota_rows").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    rows = spark.table("quota_rows").collect()
    assert sorted((r.client, r.allowed) for r in rows) == [("a", False), ("a", True), ("a", True), ("b", True)]


def test_streamed_counts(spark, tmp_path):
    df = spark.createDataFrame([("x", "2025-01-01 10:05:00"), ("x", "2025-01-01 10:50:00"), ("y", "2025-01-01 11:00:00")], "event_type string, ts string").selectExpr("event_type", "to_timestamp(ts) AS ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(live.usage_counts(stream).writeStream.format("memory").queryName("usage_rows").option("checkpointLocation", str(tmp_path / "cp")).outputMode("complete"))
    assert sorted((r.event_type, r.n) for r in spark.table("usage_rows").collect()) == [("x", 2), ("y", 1)]
