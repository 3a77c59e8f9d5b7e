"""Evaluation texts leaking into training text, found by a Wu-Manber search over words.

The alphabet is words instead of characters. Patterns are all runs of ``run`` words of the test items,
so all have the same length; a block is three words. The shift table says how far the search may jump
when a block ends at the current word; where it says 0, the pair of suffix and prefix hash selects the
bucket of test runs, and the words are compared one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.llm.wordscan import MIX_A, U64, Words, mix, pieces, slices

RUN, BLOCK = 12, 3
#: Cells of the shift table for each word of the items, so that few cells are taken whatever their number.
PER_WORD = 64
LANE = 256


def _block(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the ``BLOCK`` words that end at each place."""
    out = words[at]
    for k in range(1, BLOCK):
        out = out * MIX_A + words[at - k]
    return mix(out)


class WuManber:
    """Shift table and buckets of the runs of ``run`` words in ``items``, pairs of number and text."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN):
        if run < BLOCK:
            raise ValueError(f"a run must have at least {BLOCK} words")
        self.run, self.words = run, Words([t for _, t in items], "letters_digits")
        h, doc = self.words.hash, self.words.doc
        self.bits = min(28, max(12, math.ceil(math.log2(PER_WORD * max(1, len(h))))))
        self.shift = np.full(1 << self.bits, run - BLOCK + 1, dtype=np.int16)
        self.number = np.array([n for n, _ in items], dtype=np.int64)
        at = np.flatnonzero(doc[run - 1 :] == doc[: max(0, len(doc) - run + 1)]) + run - 1
        for back in range(run - BLOCK + 1):  # the block that ends `back` words before a run's end
            np.minimum.at(self.shift, self._cell(_block(h, at - back)), back)
        key = self._key(h, at)
        order = np.argsort(key, kind="stable")
        self.key, self.at = key[order], at[order]

    def _cell(self, block: np.ndarray) -> np.ndarray:
        return (block >> U64(64 - self.bits)).astype(np.int64)

    def _key(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mix(_block(h, at) * MIX_A + _block(h, at - self.run + BLOCK))

    def _stops(self, h: np.ndarray) -> np.ndarray:
        """Places where the shift table allows a run to end; lanes of the text advance side by side."""
        if len(h) < self.run or not len(self.key):
            return np.zeros(0, dtype=np.int64)
        at = np.arange(self.run - 1, len(h), LANE)
        end = np.minimum(at + LANE, len(h))
        found = []
        while len(at):
            step = self.shift[self._cell(_block(h, at))]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < end
            at, end = at[going], end[going]
        return np.concatenate(found)

    def search(self, texts: list[str | None]) -> set[tuple[int, int]]:
        """Pairs (place in ``texts``, item number) that share a run."""
        if not len(self.key):
            return set()
        w = Words(texts, "letters_digits")
        at = self._stops(w.hash)
        at = at[w.doc[at] == w.doc[at - self.run + 1]]
        key = self._key(w.hash, at)
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = high - low
        here = np.repeat(at, n)
        there = self.at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        for k in range(self.run):
            same = w.hash[here - k] == self.words.hash[there - k]
            here, there = here[same], there[same]
        item = self.number[self.words.doc[there]]
        out: set[tuple[int, int]] = set()
        for h, t, i in zip(here.tolist(), there.tolist(), item.tolist()):
            pair = (int(w.doc[h]), i)
            if pair not in out and all(w.word(h - k) == self.words.word(t - k) for k in range(self.run)):
                out.add(pair)
        return out


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, block_chars: int = 32_000_000) -> DataFrame:
    """``(doc_id, n)``: documents that hold at least ``run`` consecutive words of an item.

    ``documents`` needs ``doc_id, text``; ``items`` needs ``n, prompt, reference_answer``; other columns
    are ignored. A word is a maximal run of letters and digits; case, punctuation and white space do not
    count. Null or empty texts and parts of fewer than ``run`` words hold nothing; repeated rows and a
    passage found several times give one row; a null ``doc_id`` is kept as null, a null ``n`` is no item.
    Empty tables give an empty result. Items are broadcast in blocks of about ``block_chars`` characters,
    each with tables made once and searched in its own pass, so what is sent does not grow with the table. Nothing is shuffled but
    the rows found.
    """
    parts = items.filter(F.col("n").isNotNull()).select(
        F.col("n").cast("long").alias("n"), F.explode(F.array("prompt", "reference_answer")).alias("part")
    ).filter(F.col("part").isNotNull())
    chars = parts.agg(F.sum(F.length("part"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    found = None
    for b in range(blocks):
        rows = parts.filter(F.pmod(F.xxhash64("n", "part"), F.lit(blocks)) == b).collect()
        sent = documents.sparkSession.sparkContext.broadcast(WuManber([(r.n, r.part) for r in rows], run))

        def scan(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = sent.value
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                hits: set[tuple[int, int]] = set()
                for lo, hi in slices(texts):
                    if hi - lo == 1 and texts[lo]:
                        for piece in pieces(texts[lo], run):
                            hits |= {(lo, i) for _, i in search.search([piece])}
                    else:
                        hits |= {(lo + d, i) for d, i in search.search(texts[lo:hi])}
                at = sorted(hits)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([d for d, _ in at], pa.int64())), pa.array([i for _, i in at], pa.int64())],
                    names=["doc_id", "n"],
                )

        kind = documents.schema["doc_id"].dataType.simpleString()
        part = documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n bigint")
        found = part if found is None else found.unionByName(part)
    return found.select("doc_id", F.col("n").cast("int").alias("n")).distinct()
