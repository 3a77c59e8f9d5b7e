"""Operators over rows in order. Where a key may hold a large share of all rows the work is done in spans
of the order column, each its own task, and the spans are linked through one summary row each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratadoc.functions.sections import advances, candidate, segments_of
from stratadoc.functions.text import SPACE_ENDS, words
from stratadoc.schema import SEGMENT, UNKNOWN
from stratadoc.session import cut

SPAN = 10_000


def forward_fill(df: DataFrame, key: str, order: str, columns: list[str], tie: list[str] | None = None, unknown: str = UNKNOWN, span: int = SPAN) -> DataFrame:
    """Unknown values replaced by the last known one before in the order of the integer column ``order``.

    ``unknown`` and null are unknown; leading ones stay ``unknown``. Equal order values are taken by ``tie``.
    """
    rows = [F.col(order), *map(F.col, tie or [])]
    spans = df.withColumn("_span", F.floor(F.col(order) / span))
    known = {c: F.when(F.col(c) != unknown, F.col(c)) for c in columns}
    ends = spans.groupBy(key, "_span").agg(*(F.max_by(known[c], F.when(known[c].isNotNull(), F.struct(*rows))).alias(f"_{c}") for c in columns))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_key"), F.col("_span").alias("_at"), *(F.last(f"_{c}", True).over(before).alias(f"_{c}") for c in columns))
    within = Window.partitionBy(key, "_span").orderBy(*rows).rowsBetween(Window.unboundedPreceding, 0)
    joined = spans.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_at")), "left")
    filled = {c: F.coalesce(F.last(known[c], True).over(within), F.col(f"_{c}"), F.lit(unknown)) for c in columns}
    return joined.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in df.columns))


def lagged(df: DataFrame, key: str, order: str, column: str, name: str, span: int = SPAN) -> DataFrame:
    """``df`` with the value of ``column`` in the row before, null in a key's first row. ``order`` is an
    integer column, distinct within the key."""
    spans = df.withColumn("_span", F.floor(F.col(order) / span))
    ends = spans.groupBy(key, "_span").agg(F.max_by(F.struct(F.col(column).alias("v")), order).alias("_end"))
    before = F.lag("_end").over(Window.partitionBy(key).orderBy("_span"))
    carried = ends.select(F.col(key).alias("_key"), F.col("_span").alias("_at"), before.alias("_before"))
    own = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(key, "_span").orderBy(order))
    joined = spans.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_at")), "left")
    return joined.select(*df.columns, F.coalesce(own, F.col("_before"))["v"].alias(name))


def running_totals(df: DataFrame, key: str, order: str, names: dict[str, str], span: int = SPAN) -> DataFrame:
    """``df`` with the sum of each column up to and with each row, under its name in ``names``; one pass for all of them."""
    spans = df.withColumn("_span", F.floor(F.col(order) / span))
    sums = spans.groupBy(key, "_span").agg(*(F.sum(c).alias(f"_{c}") for c in names))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col(key).alias("_key"), F.col("_span").alias("_at"), *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in names))
    within = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = spans.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_at")))
    return joined.select(*df.columns, *((F.sum(c).over(within) + F.col(f"_{c}")).alias(n) for c, n in names.items()))


def numbered(df: DataFrame, key: str, order: list[str], name: str, span_of: Column) -> DataFrame:
    """``df`` with the dense position from 0 of each row in its key. ``span_of`` must not fall along the
    order; positions are counted within spans and the sizes of the spans before are added."""
    spans = df.withColumn("_span", span_of)
    sizes = spans.groupBy(key, "_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(F.col(key).alias("_key"), F.col("_span").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_span").orderBy(*order)
    joined = spans.join(offset, F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_at")))
    return joined.select(*df.columns, (F.row_number().over(within) - 1 + F.col("_before")).cast("int").alias(name))


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the position from 0 of each row in an order over everything. Rows are sorted over all
    partitions; only the partitions' sizes, a row each, come together."""
    spread = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    spread = spread.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return spread.join(offsets, "_part").select(*df.columns, (F.col("_row") + F.col("_before")).alias(name))


def last_writer(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; an aggregate, so every map task sends one row a key at most."""
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(latest.alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def first_rows(df: DataFrame, keys: list[str], order: list[str], extra: list[Column] = ()) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def distinct_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text)``: each text with the first of its lines that are equal but for white space at the ends."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
    first = lines.groupBy(key, F.regexp_replace("_line", SPACE_ENDS, "").alias("_bare")).agg(F.min_by("_line", "_pos").alias("_line"), F.min("_pos").alias("_pos"))
    kept = F.array_sort(F.collect_list(F.struct("_pos", "_line")))
    return first.groupBy(key).agg(F.array_join(F.transform(kept, lambda x: x["_line"]), "\n").alias(text))


def word_windows(df: DataFrame, key: str, text: str, size: int = 220, overlap: int = 50) -> DataFrame:
    """``(key, window, piece)``: windows of ``size`` words, each beginning ``overlap`` words before the last
    one's end, and the words that are left at the end; empty texts have none."""
    step = size - overlap
    texts = df.select(key, words(F.col(text)).alias("_words")).filter(F.size("_words") > 0)
    last = F.greatest(F.ceil((F.size("_words") - overlap) / step).cast("int"), F.lit(1)) - 1
    # the pieces are made before they become rows, so no row carries the whole text
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice("_words", k * step + 1, size), " "))
    return texts.select(key, F.posexplode(pieces).alias("window", "piece"))


def tracked_sections(df: DataFrame, file: str, order: str, text: str, lines: int = 10, span: int = SPAN) -> DataFrame:
    """``(file, order, section)``: the section each text is in, followed through each file in order.

    Candidates of the first ``lines`` lines are found as expressions; only the decision which of them is
    taken needs the state before. A text whose first candidate stands in its first two lines takes it whatever
    came before, so a file is cut at such texts into stretches that do not depend on one another; each is
    followed by itself, in one pass over sorted partitions. A file of any share of the rows is many tasks, and
    a stretch is never held in memory. ``order`` is an integer column, distinct within the file.
    """
    rows = F.slice(F.split(F.regexp_replace(text, SPACE_ENDS, ""), r"\r\n|\r|\n"), 1, lines)
    numbers = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("line"), candidate(x).alias("number"))), lambda x: x.number.isNotNull())
    found = F.transform(numbers, lambda x: F.struct(x.line.alias("line"), segments_of(x.number).alias("segments")))
    marked = cut(df.select(file, order, found.alias("found")))
    sure = (F.size("found") > 0) & (F.get("found", F.lit(0))["line"] < 2)
    stretches = forward_fill(marked.withColumn("_stretch", F.when(sure, F.col(order).cast("string"))), file, order, ["_stretch"], unknown="", span=span)
    sorted_rows = stretches.select(file, order, "found", "_stretch").repartition(file, "_stretch").sortWithinPartitions(file, "_stretch", order)

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current, label = None, None, UNKNOWN
        for batch in batches:
            out = []
            for *stretch, options in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                if stretch != at:
                    at, current, label = stretch, None, UNKNOWN
                for o in options or []:
                    if o["line"] < 2 or advances(current, o["segments"]):
                        current, label = o["segments"], "".join(s["raw"] for s in o["segments"])
                        break
                out.append(label)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[file, order, "section"])

    kinds = [T.StructField(c, df.schema[c].dataType) for c in (file, order)]
    return sorted_rows.mapInArrow(follow, T.StructType([*kinds, T.StructField("section", T.StringType())]))


__all__ = ["SEGMENT", "distinct_lines", "first_rows", "forward_fill", "last_writer", "numbered", "tracked_sections", "word_windows"]
