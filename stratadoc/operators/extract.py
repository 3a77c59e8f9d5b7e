"""From spans to classified blocks, and from blocks to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadoc.functions.sections import heading_label, looks_real
from stratadoc.functions.text import CAPTION, LIST_MARK, SENTENCE_BREAK, WEB_ADDRESS, clean_page_text, is_toc, printed_page, stripped, words
from stratadoc.operators.ordered import forward_fill, lagged, numbered, running_totals
from stratadoc.schema import UNKNOWN
from stratadoc.session import cut

SIZE, OVERLAP = 220, 50
STEP = SIZE - OVERLAP


def scanned_files(pages: DataFrame, sample: int = 30, share: float = 0.9, least: int = 50) -> DataFrame:
    """``(source_file, low_share, scanned)`` from ``(source_file, page_no, text)``: a file is scanned if at
    least ``share`` of its first ``sample`` pages have under ``least`` characters. Without pages it has no row."""
    low = F.when(F.length(stripped(F.coalesce("text", F.lit("")))) < least, 1.0).otherwise(0.0)
    some = pages.filter(F.col("page_no") <= sample).groupBy("source_file").agg(F.avg(low).alias("low_share"))
    return some.withColumn("scanned", F.col("low_share") >= share)


def styled_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages of spans: text joined with blanks and cleaned, median size (0.0 if none), whether any
    span is bold, the most frequent font (the first by name among equals) and the page's median size."""
    blocks = pages.select("file", "page", "width", "height", F.posexplode(F.filter("blocks", lambda b: b["type"] == 0)).alias("block_no", "b"))
    spans = blocks.select("file", "page", "block_no", F.posexplode(F.flatten(F.transform("b.lines", lambda x: x["spans"]))).alias("at", "s"))
    text, size = stripped(F.col("s.text")), F.col("s.size")
    shown = text != ""
    style = spans.groupBy("file", "page", "block_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("at", text.alias("t"))))), lambda x: x["t"]), " ").alias("text"),
        F.coalesce(F.percentile(F.when(size > 0, size), F.lit(0.5)), F.lit(0.0)).alias("font_size"),
        F.bool_or(F.col("s.flags").bitwiseAND(F.lit(16)) != 0).alias("bold"),
    )
    fonts = spans.filter(shown).groupBy("file", "page", "block_no", F.col("s.font").alias("font_name")).agg(F.count("*").alias("n"))
    font = fonts.groupBy("file", "page", "block_no").agg(F.max_by("font_name", F.struct("n", F.hash("font_name"), "font_name")).alias("font_name"))
    middle = spans.filter(size > 0).groupBy("file", "page").agg(F.percentile(F.col("s.size"), F.lit(0.5)).alias("page_size"))
    joined = blocks.select("file", "page", "block_no", "width", "height", F.col("b.bbox").alias("bbox")).join(style, ["file", "page", "block_no"])
    joined = joined.join(font, ["file", "page", "block_no"], "left").join(middle, ["file", "page"], "left")
    return joined.withColumns({"text": clean_page_text(F.col("text")), "font_name": F.coalesce("font_name", F.lit("")), "page_size": F.coalesce("page_size", F.lit(12.0))}).filter(F.length("text") >= 10)


def classified(blocks: DataFrame) -> DataFrame:
    """``blocks`` (``text, bbox, font_size, bold, page_size, width, height``) with ``kind``: header and footer by
    place, heading by size or by bold type and width, else body."""
    y0, y1, across = F.col("bbox")[1], F.col("bbox")[3], F.col("bbox")[2] - F.col("bbox")[0]
    text = F.col("text")
    prose = text.rlike(SENTENCE_BREAK) | text.rlike(LIST_MARK) | text.rlike(CAPTION) | text.rlike(WEB_ADDRESS)
    wide = (F.col("width") > 0) & (across / F.col("width") >= 0.4)
    kind = (
        F.when(y1 <= F.col("height") * 0.08, "header")
        .when(y0 >= F.col("height") * 0.92, "footer")
        .when((F.col("font_size") >= F.col("page_size") * 1.15) & ~prose, "heading")
        .when(F.col("bold") & (F.length(text) < 200) & ~prose & wide, "heading")
        .otherwise("body")
    )
    return blocks.withColumn("kind", kind)


def heading_fonts(blocks: DataFrame, file: str = "file") -> DataFrame:
    """``(file, fonts)``: the two most frequent fonts of a file's headings of at least 0.85 of their median size."""
    heads = blocks.filter(F.col("kind") == "heading")
    middle = heads.groupBy(file).agg(F.percentile("font_size", F.lit(0.5)).alias("middle"))
    counted = heads.join(middle, file).filter((F.col("font_size") >= 0.85 * F.col("middle")) & (F.col("font_name") != "")).groupBy(file, "font_name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(file).orderBy(F.desc("n"), "font_name"))
    return counted.withColumn("r", rank).filter("r <= 2").groupBy(file).agg(F.array_sort(F.collect_list("font_name")).alias("fonts"))


def consistent_headings(blocks: DataFrame, file: str = "file") -> DataFrame:
    """Headings in another font than the file's heading fonts become body."""
    joined = blocks.join(heading_fonts(blocks, file), file, "left")
    odd = (F.col("kind") == "heading") & (F.col("font_name") != "") & ~F.array_contains("fonts", F.col("font_name"))
    return joined.withColumn("kind", F.when(F.coalesce(odd, F.lit(False)), "body").otherwise(F.col("kind"))).drop("fonts")


def with_running_labels(blocks: DataFrame, file: str, order: str) -> DataFrame:
    """Body and heading blocks with the ``doc_page`` of the last header or footer that shows one and the
    ``section`` of the headings so far; headers, footers, tables of contents and blank-page marks are dropped.

    Once a heading has a number or a keyword, only such headings change the section, so it is the last of
    those so far, else the last heading's text. ``kind`` is read without case and padding. ``order`` is an
    integer column, distinct within the file; only it and the labels are followed through the file, and
    the texts are joined to the result once.
    """
    kind = F.lower(F.trim("kind"))
    page = F.when(kind.isin("header", "footer"), F.nullif(printed_page(F.col("text")), F.lit("")))
    out = ~kind.isin("header", "footer") & ~is_toc(F.col("text"))
    blank = F.lower("text").contains("intentionally left blank")
    label = F.when(out & (kind == "heading") & ~blank, heading_label(F.col("text")))
    marked = blocks.select(file, order, page.alias("doc_page"), label.alias("_label"), (out & ~((kind == "heading") & blank)).alias("_kept"))
    marked = cut(marked.withColumn("_real", F.when(looks_real(F.col("_label")), F.col("_label"))))
    filled = forward_fill(marked, file, order, ["doc_page", "_label", "_real"], unknown="").filter("_kept")
    shown = {c: F.nullif(F.col(c), F.lit("")) for c in ("doc_page", "_label", "_real")}
    labels = filled.select(file, order, F.coalesce(shown["doc_page"], F.lit(UNKNOWN)).alias("doc_page"), F.coalesce(shown["_real"], shown["_label"], F.lit(UNKNOWN)).alias("section"))
    return blocks.drop("doc_page", "section").withColumn("kind", kind).join(labels, [file, order])


def chunked(blocks: DataFrame, file: str = "source_file", order: str = "block_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``(file, chunk_index, text, page, doc_page, section)``: section-aware chunks of ``size`` words.

    A segment begins at each heading, and at a body block whose section differs from the block's before
    where neither is UNKNOWN. In a segment of n words chunk k is words [k step, k step + size); what is left
    is a chunk if it has 10 words before a heading, 30 before another section or the end. A heading that
    alone reaches ``size`` is left whole. A chunk has the labels of the block that completes it.

    Blocks without words are skipped. Each block sends its words to the chunks they fall in, so nothing
    longer than a chunk is put together, whatever the length of a segment or the share of a file.
    ``order`` is an integer column, distinct within the file.
    """
    step = size - overlap
    rows = blocks.select(file, F.col(order).alias("at"), "page", "doc_page", "section", (F.lower(F.trim("kind")) == "heading").alias("head"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    slim = cut(rows.select(file, "at", "page", "doc_page", "section", "head", F.size("w").alias("count"), F.struct("section", "head").alias("state")))
    slim = lagged(slim, file, "at", "state", "last")
    moved = (F.col("section") != F.col("last.section")) & (F.col("section") != UNKNOWN) & (F.col("last.section") != UNKNOWN)
    starts = slim.withColumn("new", F.when(F.col("head") | moved | F.col("last").isNull(), 1).otherwise(0))
    placed = cut(running_totals(starts, file, "at", {"new": "segment", "count": "end"}))
    segments = placed.groupBy(file, "segment").agg(
        (F.max("end") - F.min(F.col("end") - F.col("count"))).alias("n"),
        F.min(F.col("end") - F.col("count")).alias("base"),
        ((F.count("*") == 1) & F.bool_and("head")).alias("only_head"),
        F.max_by(F.struct("page", "doc_page", "section"), "at").alias("tail"),
    )
    opened = placed.filter("new = 1").select(file, (F.col("segment") - 1).alias("segment"), F.col("head").alias("closed"))
    segments = segments.join(opened, [file, "segment"], "left")
    # a heading alone is complete only once a body block follows
    full = F.when((F.col("n") < size) | F.col("only_head"), 0).otherwise(F.floor((F.col("n") - size) / step).cast("int") + 1)
    least = F.when(F.coalesce("closed", F.lit(False)), 10).otherwise(30)
    segments = segments.withColumn("full", full).withColumn("total", F.col("full") + F.when(F.col("n") - F.col("full") * step >= least, 1).otherwise(0)).filter("total > 0")

    inside = placed.join(segments.select(file, "segment", "n", "base", "full", "total"), [file, "segment"])
    inside = inside.withColumns({"upto": F.col("end") - F.col("base"), "start": F.col("end") - F.col("base") - F.col("count")})
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - size + 1) / step)).cast("int")
    last = F.least(F.col("total") - 1, F.floor((F.col("upto") - 1) / step).cast("int"))
    each = inside.filter(first <= last).join(rows.select(file, "at", "w"), [file, "at"]).select("*", F.explode(F.sequence(first, last)).alias("k"))
    stop = F.when(F.col("k") < F.col("full"), F.col("k") * step + size).otherwise(F.col("n"))
    begin = F.greatest(F.col("start"), F.col("k") * step)
    length = (F.least(F.col("upto"), stop) - begin).cast("int")
    parts = each.withColumns({"_length": length, "_from": (begin - F.col("start") + 1).cast("int")}).filter("_length > 0")
    pieces = parts.groupBy(file, "segment", "k").agg(F.array_sort(F.collect_list(F.struct("at", F.slice("w", F.col("_from"), F.col("_length")).alias("w")))).alias("p"))
    texts = pieces.select(file, "segment", "k", F.array_join(F.flatten(F.transform("p", lambda p: p["w"])), " ").alias("text"))

    before = F.when(F.col("last.head") & (F.col("new") == 0), 0).otherwise(F.col("start"))
    low = F.greatest(F.lit(0), F.floor((before - size) / step) + 1).cast("int")
    high = F.least(F.col("full") - 1, F.floor((F.col("upto") - size) / step).cast("int"))
    labels = inside.filter(~F.col("head") & (low <= high)).select(file, "segment", F.explode(F.sequence(low, high)).alias("k"), "page", "doc_page", "section")
    rest = segments.filter("total > full").select(file, "segment", F.col("full").alias("k"), "tail.*")
    made = texts.join(labels.unionByName(rest), [file, "segment", "k"])
    return numbered(made, file, ["segment", "k"], "chunk_index", F.floor(F.col("segment") / 1000)).select(file, "chunk_index", "text", "page", "doc_page", "section")
