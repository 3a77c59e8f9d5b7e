"""Changing a chunk table: appends, replacements, updates, refreshes and atomic publication.

Plain Parquet has no row updates. A table is a list of folders, each with rows, with keys whose earlier rows are
gone, or with new values of earlier rows; a change writes only its own rows and publishes a longer list. Readers
see either list whole, and nothing that is read is overwritten. ``compact`` writes it all as rows again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.functions.sections import is_section_value
from stratadoc.functions.text import chunk_id, found, last_line_page, path_metadata, stripped
from stratadoc.operators.ordered import last_writer
from stratadoc.schema import UNKNOWN, defaulted, with_missing_columns


def with_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("id", chunk_id(F.col("source_file"), F.col("page").cast("string"), F.col("chunk_index").cast("string")))


def split_failures(df: DataFrame, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Rows with an embedding, and for those without one what the dead-letter log keeps of them."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    failed = df.filter(F.col(vector).isNull()).select(
        F.lit("no embedding").alias("error"), words.alias("word_count"), F.length("text").alias("char_count"), F.substring("text", 1, 500).alias("text"), F.substring(F.concat(F.lit("'"), F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("'")), 1, 200).alias("repr")
    )
    return df.filter(F.col(vector).isNotNull()), failed


def not_yet_ingested(new: DataFrame, table: DataFrame, key: str = "source_file") -> DataFrame:
    """Rows of files the table does not hold."""
    return new.join(table.select(key).distinct(), key, "left_anti")


def replaced(table: DataFrame, new: DataFrame, key: str = "source_file") -> DataFrame:
    """The table with all rows of the files in ``new`` replaced by those of ``new``."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(table: DataFrame, condition: Column) -> DataFrame:
    """The rows for which ``condition`` does not hold; unknown counts as not."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def valid_sections(updates: DataFrame) -> DataFrame:
    """``(id, section)`` of ``updates`` that may be stored as one, one for each id."""
    return updates.filter(is_section_value(F.col("section"))).groupBy("id").agg(F.max(stripped(F.col("section"))).alias("section"))


def section_updates(table: DataFrame, updates: DataFrame) -> DataFrame:
    """``table`` with the sections of ``updates`` (``id, section``) that may be stored as one, flagged as corrected."""
    valid = valid_sections(updates).withColumnRenamed("section", "_new")
    joined = table.join(valid.select("id", "_new"), "id", "left")
    return joined.withColumns({"section": F.coalesce("_new", "section"), "llm_corrected_section": F.col("_new").isNotNull() | F.coalesce("llm_corrected_section", F.lit(False))}).drop("_new")


def current_corrections(log: DataFrame, order: str = "logged_at") -> DataFrame:
    """``(id, field, value)``: the latest usable correction of each field of each chunk.

    Legacy rows have no ``field`` (section) and their value in ``correct_section``; other fields than
    section and doc_page, empty values and UNKNOWN are skipped.
    """
    value = F.coalesce(F.nullif(F.col("correct_value"), F.lit("")), "correct_section")
    rows = log.select(
        chunk_id(F.col("source_file"), F.col("page").cast("string"), F.col("chunk_index").cast("string")).alias("id"), F.coalesce("field", F.lit("section")).alias("field"),
        stripped(value).alias("value"), F.col(order).alias("_seq"),
    )
    usable = rows.filter(F.col("field").isin("section", "doc_page") & (F.col("value") != "") & (F.col("value") != UNKNOWN))
    return last_writer(usable, ["id", "field"], ["_seq", "value"]).select("id", "field", "value")


def corrected(table: DataFrame, log: DataFrame, order: str = "logged_at") -> DataFrame:
    """``table`` with the current corrections of its rows applied and flagged; other flags stay."""
    by_id = current_corrections(log, order).groupBy("id").pivot("field", ["section", "doc_page"]).agg(F.max("value")).withColumnsRenamed({"section": "_section", "doc_page": "_doc_page"})
    joined = table.join(by_id, "id", "left")
    changes = {f: F.coalesce(f"_{f}", f) for f in ("section", "doc_page")}
    flags = {f"llm_corrected_{f}": F.col(f"_{f}").isNotNull() | F.coalesce(f"llm_corrected_{f}", F.lit(False)) for f in ("section", "doc_page")}
    return joined.withColumns(changes | flags).drop("_section", "_doc_page")


def refreshed(table: DataFrame, files: DataFrame) -> DataFrame:
    """``table`` with the hierarchy and link of ``files`` (``path, file_link``), matched by file name; of equal
    names the last path counts; rows of files that are gone stay as they are."""
    place = files.select("path", "file_link", *(c.alias(k) for k, c in path_metadata(F.col("path"), UNKNOWN).items()))
    latest = last_writer(place, ["source_file"], ["path"]).drop("path")
    names = [c for c in latest.columns if c != "source_file"]
    joined = table.join(latest.withColumnsRenamed({c: f"_{c}" for c in names}).withColumn("_found", F.lit(True)), "source_file", "left")
    return joined.withColumns({c: F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c)) for c in names}).drop("_found", *(f"_{c}" for c in names))


def stale_files(table: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the table that are no longer there."""
    return table.select("source_file").distinct().join(files.select(F.element_at(F.split("path", "/"), -1).alias("source_file")).distinct(), "source_file", "left_anti")


def page_texts(table: DataFrame) -> DataFrame:
    """``(source_file, page, text)``: the texts of each page's chunks in order, a line each."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return table.groupBy("source_file", "page").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def redetected_pages(table: DataFrame) -> DataFrame:
    """``(source_file, page, doc_page)``: printed page of each page's text; a page of chunks of different
    sections is compared with none of them."""
    section = table.groupBy("source_file", "page").agg(F.when(F.min("section") == F.max("section"), F.min("section")).alias("section"))
    joined = page_texts(table).join(section, ["source_file", "page"])
    return joined.select("source_file", "page", last_line_page(F.col("text"), F.col("section")).alias("doc_page"))


def links(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``(path, file_link)``: the first link that is not empty among ``entries`` (``priority, folder, name, url``),
    a folder's link files before the root registry (``folder`` null, ``name`` the path); '' if there is none."""
    keyed = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"))
    usable = entries.filter(F.col("url") != "")
    by_folder = keyed.join(usable.filter(F.col("folder").isNotNull()), ["folder", "name"]).select("path", "priority", "url")
    by_root = keyed.select("path").join(usable.filter(F.col("folder").isNull()).select(F.col("name").alias("path"), "priority", "url"), "path")
    best = by_folder.unionByName(by_root).groupBy("path").agg(F.min_by("url", F.struct("priority", "url")).alias("url"))
    return files.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("url", F.lit("")).alias("file_link"))


class VersionedTable:
    """A Parquet table as a list of changes, and a pointer file for each state of the list.

    An entry of the list is ``(kind, folder)``: ``rows``; ``drop``, whose values of ``key`` have no rows before it;
    ``set``, which holds ``id`` and new values of some columns of rows before it. A change writes a folder and then
    creates the pointer of the next number, which fails if another run has created it meanwhile; an interrupted
    run leaves the table as it was. The list grows by an entry or two a change; ``compact`` makes it one again.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "source_file"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _live(self) -> tuple[int, list[list[str]]]:
        """Number and entries of the newest complete list; 0 and none if there is none."""
        root = self._path(f"{self.folder}/_live")
        files = [f for f in self._fs.listStatus(root) if f.getLen() and f.getPath().getName().isdigit()] if self._fs.exists(root) else []
        if not files:
            return 0, []
        newest = max(files, key=lambda f: int(f.getPath().getName()))
        stream = self._fs.open(newest.getPath())
        try:
            entries = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return int(newest.getPath().getName()), entries

    def holds(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def exists(self) -> bool:
        return bool(self._live()[1])

    def _point(self, number: int, entries: list[list[str]]) -> None:
        try:
            stream = self._fs.create(self._path(f"{self.folder}/_live/{number + 1}"), False)
        except Exception as error:
            raise RuntimeError(f"state {number + 1} was published meanwhile") from error
        stream.write(bytearray(json.dumps(entries).encode()))
        stream.close()

    def _write(self, kind: str, df: DataFrame) -> list[str]:
        name = f"{kind}_{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.folder}/{name}")
        return [kind, name]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def read(self) -> DataFrame:
        """The table as it is now. Drops and updates that follow one another are joined as one."""
        out, entries, at = None, self._live()[1], 0
        while at < len(entries):
            kind, upto = entries[at][0], at
            while upto < len(entries) and entries[upto][0] == kind:
                upto += 1
            parts = [self._read(name) for _, name in entries[at:upto]]
            if kind == "rows":
                out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts if out is None else [out, *parts])
            elif kind == "drop":
                out = out.join(reduce(DataFrame.unionByName, parts).distinct(), self.key, "left_anti").select(*out.columns)
            else:
                numbered = [p.withColumn("_n", F.lit(n)) for n, p in enumerate(parts)]
                every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
                values = [c for c in every.columns if c not in ("id", "_n")]
                latest = every.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(f"_new_{c}") for c in values))
                out = out.join(latest, "id", "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in out.columns))
            at = upto
        return out

    def publish(self, df: DataFrame) -> None:
        """The rows of ``df`` instead of all there were."""
        number, _ = self._live()
        self._point(number, [self._write("rows", df)])

    def append(self, df: DataFrame) -> None:
        """More rows; nothing else is written."""
        number, entries = self._live()
        self._point(number, [*entries, self._write("rows", df)])

    def replace(self, df: DataFrame, gone: DataFrame | None = None) -> None:
        """The rows of ``df`` instead of those of the same keys, or of the keys in ``gone``."""
        number, entries = self._live()
        dropped = (df if gone is None else gone).select(self.key).distinct()
        self._point(number, [*entries, self._write("drop", dropped), self._write("rows", df)] if entries else [self._write("rows", df)])

    def update(self, values: DataFrame) -> None:
        """New values (``id`` and columns; null leaves a value) of rows there are, one row an ``id``."""
        number, entries = self._live()
        self._point(number, [*entries, self._write("set", values)])

    def compact(self) -> None:
        """All rows in one folder, clustered by ``key``. The folders before it stay for those who read them."""
        number, entries = self._live()
        if len(entries) > 1:
            self._point(number, [self._write("rows", self.read().repartition(self.key).sortWithinPartitions(self.key))])

    def open_or_create(self, ddl: str) -> DataFrame:
        if not self.exists():
            self.publish(self.spark.createDataFrame([], ddl))
        return defaulted(with_missing_columns(self.read(), ddl))

    def reset(self, ddl: str) -> DataFrame:
        """An empty table in the place of what there was."""
        self.publish(self.spark.createDataFrame([], ddl))
        return self.read()
