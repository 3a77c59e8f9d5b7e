"""From retrieved chunks to the context of an answer: neighbours, groups and source blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.functions.text import capped, joined_without_overlap, stripped
from stratadoc.schema import UNKNOWN

BEFORE, AFTER = 1, 2


def neighbours(hits: DataFrame, chunks: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """``(query_id, place, chunk_index, text)``: the chunks around each hit in its file and section.

    The range of indices is unrolled into at most ``before + after`` equal keys, so the join is a plain
    equi-join whatever the size of either side. A chunk stored several times counts once.
    """
    own = hits.select("query_id", "place", "source_file", "section", "chunk_index")
    offsets = F.array(*(F.lit(o) for o in range(-before, after + 1) if o))
    asked = own.select("query_id", "place", "source_file", "section", F.explode(F.transform(offsets, lambda o: F.col("chunk_index") + o)).alias("chunk_index"))
    wanted = asked.select("source_file", "section", "chunk_index").distinct()  # the texts of other chunks are not moved
    near = chunks.join(wanted, ["source_file", "section", "chunk_index"], "left_semi").groupBy("source_file", "section", "chunk_index").agg(F.min("text").alias("text"))
    return asked.join(near, ["source_file", "section", "chunk_index"]).select("query_id", "place", "chunk_index", "text")


def expanded(hits: DataFrame, chunks: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """``hits`` (one row a query and place, with the chunk's columns) with ``context``: their own text and
    those of the neighbouring chunks of the same file and section, in order and without overlaps."""
    every = neighbours(hits, chunks, before, after).unionByName(hits.select("query_id", "place", "chunk_index", "text"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    joined = every.groupBy("query_id", "place").agg(joined_without_overlap(F.transform(parts, lambda x: x["text"])).alias("context"))
    return hits.join(joined, ["query_id", "place"])


def grouped(hits: DataFrame) -> DataFrame:
    """``(query_id, idx, places, context, …)``: hits of one file and section as one source, in the order of
    the first of them; UNKNOWN and empty sections are never put together. The columns are the first hit's."""
    key = F.when(F.coalesce("section", F.lit("")).isin(UNKNOWN, ""), F.concat(F.lit("#"), F.col("place").cast("string"))).otherwise(F.concat(F.lit("="), "section"))
    rest = [c for c in hits.columns if c not in ("query_id", "place", "context")]
    members = F.array_sort(F.collect_list(F.struct("place", "context")))
    sources = hits.groupBy("query_id", "source_file", key.alias("_section")).agg(members.alias("_all"), F.min_by(F.struct(*rest), "place").alias("_first"))
    numbered = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.element_at("_all", 1)["place"].alias("at"), "_all", "_first"))).alias("_sources"))
    one = numbered.select("query_id", F.posexplode("_sources").alias("_i", "_s"))
    return one.select(
        "query_id",
        (F.col("_i") + 1).alias("idx"),
        F.transform("_s._all", lambda x: x["place"]).alias("places"),
        unique_lines(joined_without_overlap(F.transform("_s._all", lambda x: x["context"]))).alias("context"),
        *(F.col(f"_s._first.{c}").alias(c) for c in rest),
    )


def unique_lines(c):
    """Lines whose stripped form has not come before; for texts of a few lines, as contexts are."""
    lines = F.split(c, "\n")
    bare = F.transform(lines, stripped)
    return F.array_join(F.filter(lines, lambda x, i: F.array_position(bare, stripped(x)) == i + 1), "\n")


def source_block(idx, context, file, section, corrected, doc_page):
    """The text of one numbered source for the prompt."""
    shown = F.when(corrected, F.concat(section, F.lit(" [llm corrected]"))).otherwise(section)
    return F.concat(
        F.lit("--- SOURCE "), idx.cast("string"), F.lit(" ---\n"), capped(context), F.lit("\n\n[SRC_"), idx.cast("string"),
        F.lit("] Document: "), file, F.lit(" "), shown, F.lit(", page "), doc_page, F.lit("\n---"),
    )


def prompts(sources: DataFrame) -> DataFrame:
    """``(query_id, prompt)``: the sources of each query as one context, a blank line between them."""
    block = source_block(F.col("idx"), F.col("context"), F.col("source_file"), F.col("section"), F.coalesce("llm_corrected_section", F.lit(False)), F.coalesce("doc_page", F.lit(UNKNOWN)))
    parts = F.array_sort(F.collect_list(F.struct("idx", block.alias("block"))))
    return sources.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("prompt"))
