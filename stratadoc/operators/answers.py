"""Events of a streamed answer: from text to events, and from events back to the answer.

A marker names a source or says that there is no answer. An answer is sent in parts: the text before a
marker with that marker; a line once ``GUARD`` characters have come behind it; and all but the last ``GUARD``
characters once more than ``WAIT`` of them wait without a line end. A part counts from the token with which its
condition holds, and one marker is seen a token. ``parsed`` works this out from places in the whole text,
``advance`` token by token from rules on the text that waits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.functions.text import stripped

# Characters held back so that a marker cut in two is still seen, how many may wait without a
# line end, and the marker.
GUARD, WAIT = 11, 80
MARKER = re.compile(r"\^\^\^(?:(?P<n>\d+)|FAIL)\^\^\^")
_THOUGHT = re.compile(r"<think>.*?</think>", re.DOTALL)
DECLINED = "Nothing in the collection answers this."
EVENT_COLUMNS = "seq int, type string, text string, n int, raw string"


def shown(text: str) -> str:
    """A part as it is sent: without reasoning and white space at the ends."""
    return _THOUGHT.sub("", text).strip()


def _part(kind: str, text: str, n: str | None, cited: bool) -> list[dict]:
    """The events of one part: a source has the text before it, a failure none; a failure after a source has no event."""
    said = [{"type": "text", "text": t + "\n" * (kind == "line")}] if (t := shown(text)) and kind != "fail" else []
    marks = {"source": [{"type": "source_block", "n": int(n or 0)}], "fail": [] if cited else [{"type": "fail", "text": DECLINED}]}
    return said + marks.get(kind, [])


# Streams: rules on the text that waits


class State(NamedTuple):
    waiting: str = ""
    everything: str = ""
    cited: bool = False


RULES = {
    "marker": re.compile(rf"(?P<part>.*?){MARKER.pattern}", re.DOTALL),
    "line": re.compile(rf"(?P<part>[^\n]*\n)(?=.{{{GUARD}}})", re.DOTALL),
    "run": re.compile(rf"(?P<part>.{{{WAIT + 1},}})(?=.{{{GUARD}}}\Z)", re.DOTALL),
}
#: Rules that may apply next, by the one that has just applied.
AFTER = {"token": ("marker", "line", "run"), "marker": (), "line": ("line", "run"), "run": ()}


def advance(state: State, token: str) -> tuple[State, list[dict]]:
    """The state after one more token, and the events it brings."""
    waiting, cited, rule, events = state.waiting + token, state.cited, "token", []
    while match := next((m for name in AFTER[rule] if (m := RULES[name].match(waiting))), None):
        rule = next(name for name in AFTER[rule] if RULES[name] is match.re)
        kind = rule if rule != "marker" else "source" if match["n"] else "fail"
        events += _part(kind, match["part"], match.groupdict().get("n"), cited)
        cited, waiting = cited or kind == "source", waiting[match.end() :]
    return State(waiting, state.everything + token, cited), events


def finish(state: State) -> list[dict]:
    """The last events: what waits, as it is, and ``done`` with the whole."""
    return [*_part("run", state.waiting, None, state.cited), {"type": "done", "raw": shown(state.everything)}]


# Whole answers: places


def parts(text: str, size: int) -> Iterator[tuple[str, str, str | None]]:
    """``(kind, text, n)`` of the parts of an answer that comes in tokens of ``size`` characters."""
    tokens, begin, seen = -(-len(text) // size), 0, 0
    for m in MARKER.finditer(text):
        token = max(-(-m.end() // size), seen + 1)  # with which the marker is complete
        if token > tokens:
            break
        begin = yield from _before(text, begin, seen + 1, token, size)
        yield "source" if m["n"] else "fail", text[begin : m.start()], m["n"]
        begin, seen = m.end(), token
    begin = yield from _before(text, begin, seen + 1, tokens + 1, size)
    yield "run", text[begin:], None


def _before(text: str, begin: int, now: int, stop: int, size: int) -> Iterator[tuple[str, str, str | None]]:
    """Lines and runs that are sent from token ``now`` on and before token ``stop``; returns where the rest begins."""
    while True:
        end = text.find("\n", begin)
        line = max(-(-(end + 1 + GUARD) // size), now) if 0 <= end < len(text) - GUARD else stop
        run = max(-(-(begin + WAIT + 1 + GUARD) // size), now) if begin + WAIT + GUARD < len(text) else stop
        if min(line, run) >= stop:
            return begin
        if line <= run:
            yield "line", text[begin : end + 1], None
            begin, now = end + 1, line
        else:
            upto = min(run * size, len(text)) - GUARD
            yield "run", text[begin:upto], None
            begin, now = upto, run + 1


def events_of(text: str | None, size: int = 4) -> list[dict]:
    events, cited = [], False
    for kind, part, n in parts(text or "", size):
        events += _part(kind, part, n, cited)
        cited = cited or kind == "source"
    return [*events, {"type": "done", "raw": shown(text or "")}]


def parsed(responses: DataFrame, key: str, response: str, size: int = 4) -> DataFrame:
    """``(key, seq, type, text, n, raw)``: the events of each response, sent in tokens of ``size`` characters."""
    import pyarrow as pa

    kinds = {"type": pa.string(), "text": pa.string(), "n": pa.int32(), "raw": pa.string()}

    def run(batches):
        for batch in batches:
            rows = [(i, seq, e) for i, text in enumerate(batch.column(1).to_pylist()) for seq, e in enumerate(events_of(text, size))]
            columns = [pa.array([e.get(c) for *_, e in rows], t) for c, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, *_ in rows], pa.int64())), pa.array([s for _, s, _ in rows], pa.int32()), *columns], names=[key, "seq", *kinds])

    kind = responses.schema[key].dataType.simpleString()
    return responses.select(key, response).mapInArrow(run, f"{key} {kind}, {EVENT_COLUMNS}")


def framed(events: DataFrame, key: str, sources: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """The events a client gets: ``meta`` first, with what is known of the sources as JSON (``sources``: ``key, idx``
    and any columns), and for the keys in ``failed`` (``key, message``) one ``error`` in the place of all else.

    Adds the column ``message``; ``seq`` of ``meta`` is -1.
    """
    events = events.withColumn("message", F.lit(None).cast("string"))
    empty = {"text": F.lit(None).cast("string"), "n": F.lit(None).cast("int"), "raw": F.lit(None).cast("string")}
    keys = events.select(key).distinct()
    if sources is None:
        told = keys.withColumn("message", F.lit("[]"))
    else:
        listed = sources.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("idx", *(c for c in sources.columns if c not in (key, "idx")))))).alias("message"))
        told = keys.join(listed, key, "left").withColumn("message", F.coalesce("message", F.lit("[]")))
    every = events.unionByName(told.select(key, F.lit(-1).alias("seq"), F.lit("meta").alias("type"), *(c.alias(n) for n, c in empty.items()), "message"))
    if failed is None:
        return every
    broken = failed.select(key, F.lit(0).alias("seq"), F.lit("error").alias("type"), *(c.alias(n) for n, c in empty.items()), "message")
    return every.join(failed.select(key), key, "left_anti").unionByName(broken)


def rebuilt(events: DataFrame, key: str, time: str | None = None) -> DataFrame:
    """``(key, response, first_text)``: the answer of each event stream; a source block stands as its marker, fail
    and error as the FAIL marker. ``first_text`` is when the first text came, by ``time`` or place."""
    part = F.when(F.col("type") == "text", F.col("text")).when(F.col("type") == "source_block", F.concat(F.lit("\n^^^"), F.col("n").cast("string"), F.lit("^^^\n"))).when(F.col("type").isin("fail", "error"), "^^^FAIL^^^")
    at = time or "seq"
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("seq", part.alias("part")))))
    return events.groupBy(key).agg(stripped(F.array_join(F.transform(parts, lambda x: x["part"]), "")).alias("response"), F.min(F.when(F.col("type") == "text", F.col(at))).alias("first_text"))
