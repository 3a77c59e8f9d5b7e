"""Reading band of each document, from the grades at which its words and word pairs are met.

A unit's grade is the mean band of the rated texts it occurs in, each band counting alike; a document's
band is predicted from quantiles of the grades of its known units and of its sentence lengths, by a
classifier calibrated on rated documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.llm.wordscan import U64, Words, runs, slices
from stratadoc.session import cut

BANDS = 4
LEAST_WORDS = 40
#: A unit is known if LEAST_DOCUMENTS rated documents hold it, and more than the share RARE of them; so there are at
#: most as many as a mean document has, divided by RARE, however many documents are rated.
LEAST_DOCUMENTS, RARE = 3, 1 / 8192
#: Rated documents the classifier is fitted on, at most about.
FIT_ROWS = 20_000
CELLS = 64
QUANTILES = np.arange(0.05, 1, 0.05)
SMOOTHING = 0.02
_WORD = re.compile(r"[^ \t\r\n]+")
SLICE = 1 << 21


def long_enough(text: str | None, least: int = LEAST_WORDS) -> bool:
    return bool(text) and next(islice(_WORD.finditer(text), least - 1, None), None) is not None


def units(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and of the pairs of words, with the numbers of their texts."""
    return [(w.hash, w.doc), runs(w.hash, w.doc, 2)]


def sentence_lengths(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each sentence, and the numbers of the texts: a sentence ends with a mark before
    white space, at a blank line or with its text."""
    if not len(w.hash):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    chars = np.append(w.chars, [10, 10]).astype(np.uint32)
    mark = np.isin(chars, [ord(c) for c in ".!?"])
    blank = np.isin(chars, [9, 10, 13, 32])
    stop = np.flatnonzero(mark[:-1] & blank[1:])
    feeds = np.cumsum(chars == 10)
    after = np.append(w.start[1:], len(w.chars))
    ends = (np.searchsorted(stop, after) > np.searchsorted(stop, w.end)) | (feeds[after] - feeds[w.end - 1] >= 2)
    ends[:-1] |= w.doc[1:] != w.doc[:-1]
    ends[-1] = True
    at = np.flatnonzero(ends)
    return np.diff(np.concatenate(([-1], at))), w.doc[at]


def _quantiles(cell: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Quantiles and mean of the cells of each of ``n`` documents, in 0..1; a half where there are none."""
    table = np.bincount(doc * CELLS + cell, minlength=n * CELLS).reshape(n, CELLS).astype(np.float64)
    total = table.sum(axis=1, keepdims=True)
    below = np.cumsum(table, axis=1) / np.maximum(total, 1)
    at = np.stack([(below < q - 1e-9).sum(axis=1) for q in QUANTILES], axis=1)
    out = np.column_stack([at, (table @ np.arange(CELLS))[:, None] / np.maximum(total, 1)]) / (CELLS - 1)
    out[total[:, 0] == 0] = 0.5
    return out


class Grades(NamedTuple):
    """Sorted hashes and grades (in cells) of the known words, and of the known pairs."""

    hashes: tuple[np.ndarray, np.ndarray]
    cells: tuple[np.ndarray, np.ndarray]

    def features(self, texts: list[str | None]) -> np.ndarray:
        w, n = Words(texts, "letters_digits"), len(texts)
        parts = []
        for (h, doc), known, cell in zip(units(w), self.hashes, self.cells):
            if not len(known):
                parts.append(_quantiles(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), n))
                continue
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            parts.append(_quantiles(cell[at[hit]], doc[hit], n))
        length, doc = sentence_lengths(w)
        cell = np.minimum((np.log2(np.maximum(length, 1)) * 10).astype(np.int64), CELLS - 1)
        return np.hstack([*parts, _quantiles(cell, doc, n)])


class Level(NamedTuple):
    """Unit grades and the classifier on their quantiles."""

    grades: Grades
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def bands(self, texts: list[str | None]) -> np.ndarray:
        x = (self.grades.features(texts) - self.centre) / self.scale
        return np.argmax(np.hstack([x, np.ones((len(x), 1))]) @ self.weight, axis=1) + 1


def fit_classifier(x: np.ndarray, band: np.ndarray, steps: int = 1500, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multinomial logistic regression by gradient steps with momentum: centre, scale and weights."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    goal = np.eye(BANDS)[band - 1]
    weight, speed = np.zeros((z.shape[1], BANDS)), 0.0
    for _ in range(steps):
        p = z @ weight
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - rate * (z.T @ (p - goal) / len(z) + decay * weight)
        weight = weight + speed
    return centre, scale, weight


def train(documents: DataFrame, labels: DataFrame, rare: float = RARE, fit_rows: int = FIT_ROWS) -> Level:
    """Grades from all rated documents, the classifier from about ``fit_rows`` of them, chosen by a hash of
    their key. Several ratings of a document are averaged."""
    rated = labels.filter(F.col("band").between(1, BANDS) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg("band")).cast("int").alias("band"))
    rated = cut(documents.select("doc_id", "text").join(rated, "doc_id").select("doc_id", "band", "text"))
    size = {r.band: r["count"] for r in rated.groupBy("band").count().collect()}
    if not size:
        raise ValueError("no document is rated")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, texts = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for lo, hi in slices(texts, SLICE):
                w = Words(texts[lo:hi], "letters_digits")
                for kind, (h, doc) in enumerate(units(w)):
                    unit, at = np.unique(h, return_inverse=True)
                    pair, times = np.unique(at.astype(np.int64) * (hi - lo) + doc, return_counts=True)
                    unit_of, doc_of = pair // (hi - lo), pair % (hi - lo)
                    share = times / np.bincount(doc, minlength=hi - lo)[doc_of]
                    columns = [np.bincount(unit_of, share * (band[lo + doc_of] == b), minlength=len(unit)) for b in range(1, BANDS + 1)]
                    found = np.bincount(unit_of, minlength=len(unit)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), kind, dtype=np.int32)), pa.array(unit.view(np.int64)), pa.array(found), *map(pa.array, columns)], names=["kind", "unit", "found", *SHARES])

    sums = rated.mapInArrow(count, "kind int, unit bigint, found bigint, " + ", ".join(f"{s} double" for s in SHARES))
    sums = cut(sums.groupBy("kind", "unit").agg(*(F.sum(c).alias(c) for c in ("found", *SHARES))).filter(F.col("found") >= max(LEAST_DOCUMENTS, rare * sum(size.values()))))
    hashes, cells = [], []
    for kind in (0, 1):
        top = sums.filter(F.col("kind") == kind).select("unit", *SHARES).toArrow()
        rate = np.column_stack([top.column(s).to_numpy() / size.get(b, 1) for b, s in enumerate(SHARES, 1)])
        rate = rate + rate.sum(axis=1, keepdims=True) * SMOOTHING
        grade = rate @ np.arange(BANDS) / np.maximum(rate.sum(axis=1), 1e-12) / (BANDS - 1)
        unit = top.column("unit").to_numpy().view(U64)
        order = np.argsort(unit)
        hashes.append(unit[order])
        cells.append(np.clip(np.rint(grade[order] * (CELLS - 1)), 0, CELLS - 1).astype(np.int64))
    grades = Grades(tuple(hashes), tuple(cells))
    sent = documents.sparkSession.sparkContext.broadcast(grades)
    part = min(1.0, fit_rows / sum(size.values()))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            x = np.concatenate([sent.value.features(texts[lo:hi]) for lo, hi in slices(texts, SLICE)]) if texts else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["band", "x"])

    chosen = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))).filter(F.length("text") > 0)
    table = chosen.mapInArrow(features, "band int, x array<double>").toArrow()
    x = np.stack([np.asarray(v) for v in table.column("x").to_pylist()])
    return Level(grades, *fit_classifier(x, table.column("band").to_numpy()))


SHARES = ("s1", "s2", "s3", "s4")


def reading_bands(documents: DataFrame, level: Level, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, band)`` for every document of at least ``least_words`` words, bands from 1 to 4.

    Null, empty and shorter texts have no row. Repeated rows are judged each on its own, a null ``doc_id``
    stays null. A document without a known unit is judged by its sentences. Other columns are ignored; an
    empty table gives an empty result. No shuffle.
    """
    sent = documents.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if long_enough(t, least_words)]
            kept = [texts[i] for i in at]
            bands = np.concatenate([sent.value.bands(kept[lo:hi]) for lo, hi in slices(kept, SLICE)]) if kept else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(bands.astype(np.int32))], names=["doc_id", "band"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, band int")
