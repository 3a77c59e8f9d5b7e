"""Embedding and language models behind services, as functions the engine takes in the place of its stand-ins.

A model is called from the workers, each partition at its host in turn; a call is tried again a few times, and an
input that is too long for the model once more shortened. Inputs without a result come back as null.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How often and after how many seconds a call is tried again, words of a shortened input, and the
# options of generation.
ATTEMPTS, WAIT, SHORTENED = 3, 2.0, 150
OPTIONS = {"temperature": 0.1, "num_ctx": 8192, "num_predict": 1500}
#: What the model is asked for; its markers are what ``answers`` reads.
CONTRACT = (
    "Answer the question from the numbered sources below and from nothing else. Write bullets that repeat the sources' wording. "
    "After the bullets taken from source N write a line of its own with ^^^N^^^, one such line for each source used. "
    "Only if no source bears on the question, write ^^^FAIL^^^ and nothing else."
)


class TooLong(Exception):
    """The input exceeds what the model takes."""


def tried(call: Callable[[], object], attempts: int = ATTEMPTS, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of ``call``, tried again after failures other than ``TooLong``; the last failure is raised."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except TooLong:
            raise
        except Exception:
            if not left:
                raise
            sleep(wait)


def payload(model: str, question: str, context: str) -> dict:
    """What is sent to a language model."""
    return {"model": model, "system": CONTRACT, "prompt": f"{context}\n\nQuestion: {question}", "options": OPTIONS}


def prompt_of(question: Column, context: Column) -> Column:
    return F.concat(F.lit(CONTRACT + "\n\n"), context, F.lit("\n\nQuestion: "), question)


def _hosted(hosts: Sequence[str]) -> str:
    context = TaskContext.get()
    return hosts[(context.partitionId() if context else 0) % len(hosts)]


def embedder(call: Callable[[str, str], list[float]], hosts: Sequence[str], attempts: int = ATTEMPTS, wait: float = WAIT) -> Callable[[DataFrame, str], DataFrame]:
    """An embedder for the engine: ``call(host, text)`` gives a vector. One that raises ``TooLong`` is called once more
    with the first ``SHORTENED`` words; a text it gives nothing for has a null vector."""

    def embed(df: DataFrame, text: str, name: str = "vector") -> DataFrame:
        def vector(host: str, value: str | None) -> list[float] | None:
            try:
                return tried(lambda: call(host, value), attempts, wait) if value else None
            except TooLong:
                try:
                    return tried(lambda: call(host, " ".join(value.split()[:SHORTENED])), attempts, wait)
                except Exception:
                    return None
            except Exception:
                return None

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            host = _hosted(hosts)
            for batch in batches:
                made = [vector(host, v) for v in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float32()))], names=[*batch.schema.names, name])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))

    return embed


def answered(prompts: DataFrame, call: Callable[[str, dict], str], hosts: Sequence[str], model: str, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """``prompts`` (``query, prompt``) with ``answer`` by ``call(host, payload)`` and ``message``, what failed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = _hosted(hosts)
        for batch in batches:
            said, failed = [], []
            for q, p in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("query", "prompt"))):
                try:
                    said.append(tried(lambda q=q, p=p: call(host, payload(model, q or "", p or "")), attempts, wait))
                    failed.append(None)
                except Exception as error:
                    said.append(None)
                    failed.append(str(error) or type(error).__name__)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(failed, pa.string())], names=[*batch.schema.names, "answer", "message"])

    return prompts.mapInArrow(run, T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType()), T.StructField("message", T.StringType())]))


def recognised(pages: DataFrame, call: Callable[[bytes, str], str], least: int = 50) -> DataFrame:
    """``pages`` (``image``, a rendered page) with ``text`` by ``call(image, mode)``: the mode ``page`` first, and
    ``block`` where that finds fewer than ``least`` characters. A null image, or one that cannot be read, has a null text."""

    def read(image: bytes | None) -> str | None:
        if image is None:
            return None
        try:
            text = call(image, "page")
            return text if len(text.strip()) >= least else call(image, "block")
        except Exception:
            return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [read(x) for x in batch.column(batch.schema.get_field_index("image")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "text"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())]))
