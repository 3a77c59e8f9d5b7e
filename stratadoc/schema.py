"""Schemas of the engine's tables, requests and events, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = (
    "id string, text string, vector array<float>, source_file string, jurisdiction string, agency string, state string, locality string, "
    "file_link string, section string, llm_corrected_section boolean, llm_corrected_doc_page boolean, doc_page string, page int, chunk_index int"
)
BLOCK = (
    "text string, kind string, page int, doc_page string, section string, bold boolean, font_size double, font_name string, bbox array<double>"
)
SPAN_PAGE = (
    "file string, page int, width double, height double, "
    "blocks array<struct<type:int,bbox:array<double>,lines:array<struct<spans:array<struct<text:string,size:double,font:string,flags:int>>>>>>"
)
CORRECTION = (
    "source_file string, page int, chunk_index int, old_value string, correct_value string, field string, timestamp string, correct_section string"
)
QUERY_LOG = "ts string, query string, response string"
REQUEST = "query string, filter_agency string, filter_jurisdiction string, filter_state string, filter_locality string"
EVENT = "type string, text string, n int, raw string, message string"
SEGMENT = "array<struct<type:string,value:string,int_val:bigint,raw:string>>"

UNKNOWN = "UNKNOWN"
#: Sentinel of a hit that has no vector distance.
NO_DISTANCE = -1.0

DEFAULTS = {"file_link": "", "llm_corrected_section": False, "llm_corrected_doc_page": False, "state": "", "locality": "", "section": UNKNOWN, "doc_page": UNKNOWN}


def with_missing_columns(df: DataFrame, schema: str = CHUNK) -> DataFrame:
    """``df`` with every column of ``schema``: one it lacks is added with its default, else null."""
    have = set(df.columns)
    return df.withColumns({f.name: F.lit(DEFAULTS.get(f.name)).cast(f.dataType) for f in T.StructType.fromDDL(schema) if f.name not in have})


def defaulted(df: DataFrame) -> DataFrame:
    """Nulls replaced by the column defaults."""
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns})


def request_problems(df: DataFrame) -> DataFrame:
    """Correction and document requests with the list of bounds they break (``problems``, empty if none).

    Bounds: page and chunk_index in 0..99,999; document up to 200, notes up to 500, email up to 120 characters.
    """
    def outside(c: str):
        return F.when(~F.col(c).between(0, 99_999) | F.col(c).isNull(), F.lit(c))

    def too_long(c: str, most: int):
        return F.when(F.length(c) > most, F.lit(c))

    checks = [outside(c) for c in ("page", "chunk_index") if c in df.columns]
    checks += [too_long(c, n) for c, n in (("document", 200), ("notes", 500), ("email", 120)) if c in df.columns]
    return df.withColumn("problems", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))
