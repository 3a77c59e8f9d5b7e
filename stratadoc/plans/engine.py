"""The engine's surface: ingestion, retagging, answering, corrections, facets and usage over one folder."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stratadoc import config, schema
from stratadoc.functions.text import embedding_input, path_metadata
from stratadoc.operators import answers, catalogue_views, context, extract, ordered, search, upkeep, usage
from stratadoc.session import cut
from stratadoc.sources import readers

Embedder = Callable[[DataFrame, str], DataFrame]
CACHE_SECONDS = 3600


class Engine:
    """Chunks, corrections, queries and usage below ``folder``; ``embed`` adds the column ``vector`` to rows.

    Queries are logged only with ``log_queries``. Models are stand-ins unless others are given; one that
    wants a prefix before queries (``text.QUERY_PREFIX``) gets it as ``query_prefix``.
    """

    def __init__(self, spark: SparkSession, folder: str, embed: Embedder = search.embedded, settings: config.Config | None = None, log_queries: bool = False, query_prefix: str = ""):
        self.query_prefix = query_prefix
        self.spark, self.folder, self.embed = spark, folder.rstrip("/"), embed
        self.settings, self.log_queries = settings or config.load(), log_queries
        self.table = upkeep.VersionedTable(spark, f"{self.folder}/chunks")
        self._facets: tuple[float, dict[str, list]] | None = None

    def chunks(self) -> DataFrame:
        return self.table.open_or_create(schema.CHUNK)

    def lookup(self, id: str) -> DataFrame:
        """The chunk of one id, if there is one."""
        return self.chunks().filter(F.col("id") == id).limit(1)

    def remove(self, condition: Column) -> None:
        """Delete the chunks for which ``condition`` holds; this writes the table again."""
        self.table.publish(upkeep.without(self.chunks(), condition))
        self._facets = None

    # Ingestion

    @staticmethod
    def blocks_of(pages: DataFrame) -> DataFrame:
        """Blocks to ingest of pages of spans (``readers.page_spans`` or ``parsed_pages``): styled, classified, headings
        made consistent within each file, numbered in order of pages and places."""
        made = extract.consistent_headings(extract.classified(extract.styled_blocks(pages)))
        return made.withColumn("block_id", F.col("page").cast("long") * 100_000 + F.col("block_no")).withColumnRenamed("file", "source_file")

    def ingest(self, blocks: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
        """Add the files of ``blocks`` (``block_id, source_file, text, kind, page``) whose places are in ``files``
        (``path, file_link``); files the table holds are passed over, or replaced with ``force``. Returns the
        dead letters: chunks that could not be embedded, which are also logged."""
        table = self.chunks()
        new = blocks if force else upkeep.not_yet_ingested(blocks, table)
        made = extract.chunked(extract.with_running_labels(new, "source_file", "block_id"))
        place = files.select("file_link", "path", *(c.alias(k) for k, c in path_metadata(F.col("path")).items()))
        place = ordered.last_writer(place, ["source_file"], ["path"]).drop("path")
        tagged = upkeep.with_ids(made.join(place, "source_file", "left"))
        filled = schema.defaulted(schema.with_missing_columns(ordered.forward_fill(tagged, "source_file", "chunk_index", ["section", "doc_page"])).drop("vector"))
        filled = filled.withColumns({c: F.coalesce(c, F.lit(schema.UNKNOWN)) for c in ("jurisdiction", "agency")})
        embedded = cut(self.embed(filled.withColumn("_input", embedding_input(F.col("text"))), "_input").drop("_input"))
        kept, failed = upkeep.split_failures(embedded)
        names = schema.T.StructType.fromDDL(schema.CHUNK).names
        if force:
            self.table.replace(kept.select(names), blocks)
        else:
            self.table.append(kept.select(names))
        readers.append_log(failed, f"{self.folder}/dead_letters")
        self._facets = None
        return failed

    def retag(self, files: DataFrame) -> DataFrame:
        """Refresh the places of all chunks from ``files``, find sections and printed pages again from the texts,
        apply the correction log and publish. Returns the files of the table that are no longer there."""
        table = cut(self.chunks())
        moved = upkeep.refreshed(table, files)
        sections = ordered.tracked_sections(moved, "source_file", "chunk_index", "text").withColumnRenamed("section", "_section")
        pages = upkeep.redetected_pages(moved).withColumnRenamed("doc_page", "_doc_page")
        joined = moved.join(sections.distinct(), ["source_file", "chunk_index"], "left").join(pages, ["source_file", "page"], "left")
        again = joined.withColumns({"section": F.coalesce("_section", F.lit(schema.UNKNOWN)), "doc_page": F.coalesce("_doc_page", F.lit(schema.UNKNOWN))}).drop("_section", "_doc_page")
        self.table.publish(upkeep.corrected(again, self.corrections()).select(table.columns))
        self._facets = None
        return upkeep.stale_files(table, files)

    def preview(self, blocks: DataFrame, n: int = 15) -> DataFrame:
        """The first ``n`` blocks of each file as they would be chunked, with their labels; nothing is written."""
        labelled = extract.with_running_labels(blocks, "source_file", "block_id")
        return ordered.numbered(labelled, "source_file", ["block_id"], "place", F.floor(F.col("block_id") / ordered.SPAN)).filter(F.col("place") < n)

    def reset(self) -> None:
        """Empty the chunk table; logs stay."""
        self.table.reset(schema.CHUNK)
        self._facets = None

    def index_texts(self) -> str:
        """Write the full-text index of the table as it is now, sorted by term so that a query reads few row groups.
        Returns its folder; answers use it until the table changes."""
        folder = f"{self.folder}/text_index/{self.table._live()[0]}"
        search.postings(self.chunks(), "id", "text", search.FACETS).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(folder)
        return folder

    def _text_index(self) -> DataFrame | None:
        folder = f"{self.folder}/text_index/{self.table._live()[0]}"
        return self.spark.read.parquet(folder) if self.table.holds(f"{folder}/_SUCCESS") else None

    # Corrections

    def corrections(self) -> DataFrame:
        try:
            return readers.correction_log(self.spark, f"{self.folder}/corrections")
        except AnalysisException:  # nothing is logged yet
            return self.spark.createDataFrame([], schema.CORRECTION).withColumn("logged_at", F.to_timestamp("timestamp"))

    def correct(self, changes: DataFrame) -> DataFrame:
        """Log section corrections (``source_file, page, chunk_index, section``) that are within bounds and may be
        sections, apply them, and return the others with what is wrong with them."""
        checked = cut(schema.request_problems(changes))
        good = checked.filter(F.size("problems") == 0).drop("problems")
        updates = upkeep.with_ids(good).select("id", "section")
        before = self.chunks().select("id", F.col("section").alias("old_value"))
        rows = upkeep.with_ids(good).join(before, "id").select(
            "source_file", "page", "chunk_index", "old_value", F.col("section").alias("correct_value"), F.lit("section").alias("field"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
        )
        readers.append_log(rows, f"{self.folder}/corrections")
        self.table.update(upkeep.valid_sections(updates).withColumn("llm_corrected_section", F.lit(True)))
        return checked.filter(F.size("problems") > 0)

    # Answers

    def answer(self, requests: DataFrame, distance: float = search.MAX_DISTANCE) -> DataFrame:
        """``(query_id, prompt, answer)`` for requests (``query_id, query`` and facets to filter by); a query
        nothing is found for has the FAIL marker as its answer."""
        shown = schema.with_missing_columns(requests, schema.REQUEST).withColumn("_input", F.concat(F.lit(self.query_prefix), "query"))
        asked = cut(self.embed(shown, "_input").drop("_input"))
        chunks = self.chunks()
        hits = cut(search.retrieve(chunks, asked, most=distance, floor=self.settings.rerank_floor, index=self._text_index()).withColumn("place", F.col("rerank_place")))
        sources = context.grouped(context.expanded(hits, chunks))
        line = F.struct("idx", search.extractive_answer(F.col("context"), F.col("idx")).alias("line"))
        said = sources.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("answer"))
        found = context.prompts(sources).join(said, "query_id")
        out = requests.select("query_id", "query").join(found, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit("^^^FAIL^^^")))
        if self.log_queries:
            out = cut(out)
            readers.append_log(out.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "query", F.col("answer").alias("response")), f"{self.folder}/query_log")
        return out.select("query_id", "prompt", "answer")

    def events(self, answered: DataFrame) -> DataFrame:
        """The events a client gets for each answer; one with a ``message`` of what failed gets an error."""
        failed = answered.filter("message is not null").select("query_id", "message") if "message" in answered.columns else None
        return answers.framed(answers.parsed(answered, "query_id", "answer"), "query_id", failed=failed)

    def admitted(self, requests: DataFrame) -> DataFrame:
        """Those of ``requests`` (``request_id, client, ts`` and more) within the daily limit; the others are logged."""
        checked = cut(usage.within_quota(requests, "client", "ts", "request_id", self.settings.daily_limit))
        readers.append_lines(checked.filter(~F.col("allowed")).withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), f"{self.folder}/rate_limited", "at", "client")
        return checked.filter("allowed").drop("allowed")

    def smoke(self) -> dict[str, object]:
        """One fixed question through the whole of retrieval."""
        asked = self.spark.createDataFrame([("smoke", "What are the requirements for fall protection?")], "query_id string, query string")
        row = self.answer(asked, distance=4.0).first()
        return {"ok": row is not None, "failed": row.answer == "^^^FAIL^^^"}

    # Catalogue and usage

    def facets(self) -> dict[str, list]:
        """Agencies, states, localities and scopes in display order, kept for an hour; nothing found is not kept."""
        if self._facets and time.monotonic() - self._facets[0] < CACHE_SECONDS:
            return self._facets[1]
        chunks = self.chunks()
        views = {
            "agencies": catalogue_views.agencies(chunks).orderBy("jurisdiction", "agency"), "states": catalogue_views.states(chunks).orderBy("state"),
            "localities": catalogue_views.localities(chunks).orderBy("state", "display", "locality"), "scopes": catalogue_views.scopes(chunks).orderBy("jurisdiction", "state", "locality"),
        }
        found = {k: [r.asDict() for r in v.collect()] for k, v in views.items()}
        if any(found.values()):
            self._facets = (time.monotonic(), found)
        return found

    def catalogue(self) -> DataFrame:
        return catalogue_views.catalogue(self.chunks()).orderBy("agency", "source_file")

    def health(self) -> dict[str, object]:
        return {"environment": self.settings.environment, "chunks": self.chunks().count()}

    def record(self, events: DataFrame) -> None:
        """Append usage events (``kind, key, client, ts, delta``); unknown kinds are dropped."""
        readers.append_log(events.filter(F.col("kind").isin("query", "failed", "manual_pull", "correction")), f"{self.folder}/usage")

    def usage(self) -> DataFrame:
        """``(kind, key, n)``: the counters, undone events subtracted."""
        log = readers.json_log(self.spark, f"{self.folder}/usage", "kind string, key string, client string, ts string, delta int")
        return usage.net_counts(log.withColumn("delta", F.coalesce("delta", F.lit(1))), ["kind", "key"])

    def dashboard(self, days: int = 30) -> tuple[list[tuple[str, int]], dict[str, int]]:
        """Queries of each of the last days, and the totals of the week and of all time."""
        log = readers.json_log(self.spark, f"{self.folder}/usage", "kind string, key string, client string, ts string, delta int")
        counts = usage.by_day(log.filter("kind = 'query'").withColumn("ts", F.to_timestamp("ts")))
        series = usage.series(counts, F.current_date(), days).orderBy("day").collect()
        return [(r.day, r.n) for r in series], usage.totals(counts, F.current_date()).first().asDict()

    def request_document(self, requests: DataFrame) -> DataFrame:
        """Log requests for documents (``document, notes, email``) that name one and are within bounds; returns the rest."""
        checked = schema.request_problems(requests)
        bad = (F.size("problems") > 0) | (F.trim(F.coalesce("document", F.lit(""))) == "")
        rows = checked.filter(~bad).withColumn("at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
        readers.append_lines(rows, f"{self.folder}/document_requests", "at", "document", "notes", "email")
        return checked.filter(bad)
