"""Facets, the document catalogue and its hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.functions.text import without_pdf
from stratadoc.operators.ordered import first_rows

PLACES = ("FEDERAL", "STATE", "LOCAL")


def some(c: str):
    return F.col(c).isNotNull() & (F.col(c) != "")


def catalogue(df: DataFrame, order: str = "id") -> DataFrame:
    """One row for each file, the first by ``order``: file, agency, jurisdiction, state, locality and link."""
    columns = ("agency", "jurisdiction", "state", "locality", "file_link")
    rows = df.filter(some("source_file")).select("source_file", *(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.col(order).alias("_order"))
    return first_rows(rows, ["source_file"], ["_order", *columns]).drop("_order")


def agencies(df: DataFrame, order: str = "id") -> DataFrame:
    """Each agency with jurisdiction, state and locality of its first row."""
    rows = df.filter(some("agency")).select("agency", *(F.coalesce(c, F.lit("")).alias(c) for c in ("jurisdiction", "state", "locality")), F.col(order).alias("_order"))
    return first_rows(rows, ["agency"], ["_order", "jurisdiction", "state", "locality"]).drop("_order")


def states(df: DataFrame) -> DataFrame:
    return df.filter(some("state")).select("state").distinct()


def localities(df: DataFrame, order: str = "id") -> DataFrame:
    """Each state and locality with the agency of its first row as display name."""
    rows = df.filter(some("state") & some("locality")).select("state", "locality", F.coalesce("agency", F.lit("")).alias("display"), F.col(order).alias("_order"))
    return first_rows(rows, ["state", "locality"], ["_order", "display"]).drop("_order")


def scopes(df: DataFrame) -> DataFrame:
    return df.filter(some("jurisdiction")).select("jurisdiction", F.coalesce("state", F.lit("")).alias("state"), F.coalesce("locality", F.lit("")).alias("locality")).distinct()


def place_rank(c: str = "jurisdiction"):
    """FEDERAL, STATE and LOCAL first, the rest after them."""
    return F.coalesce(*(F.when(F.col(c) == p, i) for i, p in enumerate(PLACES)), F.lit(len(PLACES)))


def nested(files: DataFrame) -> DataFrame:
    """``(jurisdiction, state, locality, agency, position, documents)``: the catalogue's groups in display
    order, each with its documents by title."""
    groups = files.groupBy(*(F.coalesce(c, F.lit("")).alias(c) for c in ("jurisdiction", "state", "locality", "agency")))
    listed = groups.agg(F.array_join(F.array_sort(F.collect_list(without_pdf(F.col("source_file")))), "; ").alias("documents"))
    return listed.withColumn("position", place_rank())


def catalogue_json(files: DataFrame) -> DataFrame:
    """The catalogue as one JSON text, by agency and file; its size is that of the list of files."""
    row = F.struct("agency", "source_file", "jurisdiction", "state", "locality", "file_link")
    return files.agg(F.to_json(F.array_sort(F.collect_list(row))).alias("catalogue"))
