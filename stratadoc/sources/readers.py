"""Readers and writers at the engine's edges."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc import schema

#: Most bytes of link files that are read.
LINK_BYTES = 64_000_000
TIERS = ("FEDERAL", "STATE", "LOCAL")


def documents_under(spark: SparkSession, root: str, only: str | None = None, pattern: str = "*.pdf") -> DataFrame:
    """``(path, modificationTime, length)`` of the files below ``root``, paths relative to it; with ``only``
    those in that subfolder. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    listed = files.select(relative.alias("path"), "modificationTime", "length")
    return listed.filter(F.col("path").startswith(only.strip("/") + "/")) if only else listed


def misplaced(files: DataFrame) -> DataFrame:
    """Files whose first folder is none of the tiers."""
    return files.filter(~F.upper(F.split("path", "/")[0]).isin(*TIERS))


def link_entries(spark: SparkSession, root: str) -> DataFrame:
    """``(priority, folder, name, url)`` of the link files below ``root``: _links.json, links.json and
    *_links.json of a folder in that order, then the root's _registry.json, whose names are paths.

    Spark's own readers pass over names with a leading underscore, so these few small files are read on the
    driver, up to ``LINK_BYTES`` in all. Broken ones have no entries.
    """
    found, total = [], 0
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.resolvePath(root).toString().rstrip("/") + "/"
    listed = fs.listFiles(root, True)
    while listed.hasNext():
        file = listed.next()
        if file.getPath().getName().endswith(("links.json", "_registry.json")):
            total += file.getLen()
            if total > LINK_BYTES:
                raise ValueError(f"the link files hold more than {LINK_BYTES} bytes")
            stream = fs.open(file.getPath())
            found.append((file.getPath().toString().removeprefix(base), bytes(stream.readAllBytes()).decode("utf-8", "replace")))
            stream.close()
    files = spark.createDataFrame(found, "path string, value string")
    path = F.col("path")
    name = F.element_at(F.split(path, "/"), -1)
    priority = F.when(name == "_links.json", 1).when(name == "links.json", 2).when(name.endswith("_links.json"), 3).when(path == "_registry.json", 4)
    folder = F.when(priority < 4, F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(""))
    rows = files.select(priority.alias("priority"), folder.alias("folder"), F.from_json("value", "map<string,string>").alias("links")).filter("priority is not null and links is not null")
    return rows.select("priority", "folder", F.explode("links").alias("name", "url"))


def json_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A log of JSON lines; blank and broken lines are skipped, missing fields are null."""
    return spark.read.schema(f"{ddl}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path).filter("_broken is null").drop("_broken")


def correction_log(spark: SparkSession, path: str) -> DataFrame:
    """The correction log with its order, by time and place in the files."""
    return json_log(spark, path, schema.CORRECTION).withColumn("logged_at", F.to_timestamp("timestamp"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_lines(df: DataFrame, path: str, *columns: str) -> None:
    """Lines of text, the columns with bars between them."""
    df.select(F.concat_ws(" | ", *columns).alias("value")).write.mode("append").text(path)


def sse_events(lines: DataFrame) -> DataFrame:
    """``lines`` (``stream_id, seq, value``) of a server-sent event stream as event rows."""
    data = lines.filter(F.col("value").startswith("data:")).select("stream_id", "seq", F.from_json(F.trim(F.substr("value", F.lit(6))), schema.EVENT).alias("e"))
    return data.filter("e is not null").select("stream_id", "seq", "e.*")


def sse_lines(events: DataFrame) -> DataFrame:
    """Event rows as lines of a server-sent event stream."""
    return events.select("stream_id", "seq", F.concat(F.lit("data: "), F.to_json(F.struct("type", "text", "n", "raw", "message"))).alias("value"))


def page_spans(spark: SparkSession, path: str) -> DataFrame:
    """Pages of spans, as a PDF reader leaves them, from JSON lines."""
    return spark.read.schema(schema.SPAN_PAGE).json(path)


def parsed_pages(spark: SparkSession, root: str, read: Callable[[bytes], list[dict]], pattern: str = "*.pdf") -> DataFrame:
    """Pages of spans of the files below ``root``: ``read`` makes a list of pages (``page, width, height, blocks``) of a
    file's bytes. A file it fails on has no pages. One file is one row, so it must fit into a worker."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    pages = read(content)
                except Exception:
                    continue
                names += [path.rsplit("/", 1)[-1]] * len(pages)
                values += [json.dumps(p) for p in pages]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], names=["file", "value"])

    parsed = files.mapInArrow(run, "file string, value string").select("file", F.from_json("value", schema.SPAN_PAGE).alias("p"))
    return parsed.select("file", *(f"p.{c}" for c in ("page", "width", "height", "blocks")))
