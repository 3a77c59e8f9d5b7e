"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, verified by
weighted Jaccard similarity.

A shingle's weight in a text is the number of times it stands there times its idf, ln(1 + 1/share) for the
share of texts that hold it. Shingles in fewer than one text of ``1 / RARE`` count as that rare, so the weights
mean the same in a collection of any size, and the table of the more frequent ones, which is all that is sent
to the workers, is bounded by the mean number of shingles in a text divided by ``RARE / 2``. Shingles in more than
the share ``COMMON`` count as that common: else the edits of a text that a third of all rows hold would outweigh
what they share. So texts whose sets of shingles have a Jaccard of a half have a weighted one of 0.3997 at least,
but for shingles that one of them holds more often than the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadoc.llm.wordscan import MIX_A, U64, Words, mix, runs, slices
from stratadoc.session import cut, release

SHINGLE, THRESHOLD = 3, 0.5
#: Weighted Jaccard from which on pairs are looked at where an exact set Jaccard of ``THRESHOLD`` is asked for.
LOOSE = 0.39
#: Columns of the grid of samples that bands are lines of, and its rows, the samples of a band, for up to ``SETS`` texts.
BANDS, ROWS, SETS = 40, 3, 1 << 20
#: For so many times more texts a band has a sample more, as unlike texts share one of some thirty samples.
STEP = 32
#: Slopes of the lines by the samples of a band: as many as miss 1 % of pairs at a weighted Jaccard of 0.4 (simulated).
SLOPES = {3: 2, 4: 6, 5: 17}
#: Band keys of a text that are joined at once; half as many where there are more, since then the keys themselves take room.
AT_ONCE = 80
#: Share of texts below which all shingles count as equally rare, and above which as equally common.
RARE, COMMON = 1 / 1024, 1 / 100
PARAM_BITS = 16
SLICE, COUNTED = 1 << 21, 1 << 24
#: A sketch has four bits of each of up to 128 samples, in two halves; bands carry two of the four.
SKETCH = ("s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8")
CARRIED = SKETCH[:4]


class Shares(NamedTuple):
    """Hashes of the shingles that are not rare, in order, and the share of texts that hold each."""

    hash: np.ndarray
    share: np.ndarray

    def idf(self, h: np.ndarray) -> np.ndarray:
        """ln(1 + 1/share) of each shingle, between those of ``COMMON`` and ``RARE``."""
        share = np.full(len(h), RARE)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            share = np.where(self.hash[at] == h, np.clip(self.share[at], RARE, COMMON), RARE)
        return np.log1p(1 / share)


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, in order of text and hash, the numbers of the texts and how often each
    stands in its text."""
    w = Words(texts, "ascii")
    h, doc = runs(w.hash, w.doc, n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def document_shares(df: DataFrame, text: str, n: int) -> Shares:
    """Shares of the shingles that at least one row of ``1 / RARE`` holds, counted over all rows.

    Each task counts its rows in portions of ``COUNTED`` characters and passes on the shingles that more than half
    that share of the portion's rows hold, which any shingle frequent enough does in some portion; the counts are
    added up by hash with map-side combination. So a share is too small by ``RARE / 2`` at most, and what the
    driver gets is bounded whatever the number of rows.
    """

    def portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = size = 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in slices(texts, SLICE):
                held.append(shingles(texts[lo:hi], n)[0])
                rows += hi - lo
                size += sum(map(len, texts[lo:hi]))
                if size >= COUNTED:
                    yield counted(held, rows)
                    held, rows, size = [], 0, 0
        if rows:
            yield counted(held, rows)

    def counted(held: list[np.ndarray], rows: int) -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(held), return_counts=True)
        often = count > rows * RARE / 2
        return pa.RecordBatch.from_arrays([_signed(np.append(h[often], U64(0))), pa.array(np.append(count[often], rows)), pa.array(np.append(np.zeros(often.sum(), dtype=bool), True))], names=["h", "n", "total"])

    counts = cut(df.select(text).mapInArrow(portions, "h bigint, n bigint, total boolean").groupBy("total", "h").agg(F.sum("n").alias("n")))
    rows = (counts.filter("total").first() or {"n": 0})["n"]
    often = counts.filter(~F.col("total") & (F.col("n") > rows * RARE / 2)).select("h", "n").orderBy(F.col("h") < 0, "h").toArrow()
    return Shares(often.column(0).to_numpy().view(U64), often.column(1).to_numpy() / max(rows, 1))


@lru_cache(maxsize=1)
def _draws() -> np.ndarray:
    """Draws of the sampling scheme by hash: 1/r, beta, ln c - r + r beta, r, with r and c from Gamma(2, 1)."""
    random = np.random.default_rng(20)
    r, c = random.gamma(2, 1, (2, 1 << PARAM_BITS))
    beta = random.random(1 << PARAM_BITS)
    return np.stack([1 / r, beta, np.log(c) - r + r * beta, r], axis=1)


def signatures(h: np.ndarray, doc: np.ndarray, times: np.ndarray, shares: Shares, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Consistent weighted samples: a row of ``hashes`` values for each text that has shingles, and the
    texts' numbers. The smallest ln a of a text depends only on the sampled shingle and its level, so its
    bits stand for the sample; a trace of the hash tells shingles apart that share their draws."""
    _, one, back = np.unique(h + mix(times.astype(U64)), return_index=True, return_inverse=True)
    distinct = h[one]
    log_weight = np.log(shares.idf(distinct) * times[one])
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    out = []
    draws = _draws()
    for salt in mix(np.arange(1, hashes + 1, dtype=U64)):
        x = mix(distinct + salt)
        inverse, beta, offset, r = draws[(x >> U64(64 - PARAM_BITS)).astype(np.int64)].T
        log_a = offset - r * np.floor(log_weight * inverse + beta) + (x & U64(0xFFFFF)).astype(np.float64) * 1e-13
        out.append(np.minimum.reduceat(log_a[back], first).view(U64))
    return mix(np.stack(out, axis=1)), doc[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def band_rows(texts: int) -> int:
    """Samples of a band for so many texts. Unlike texts that meet in a band grow with the square of the texts;
    a longer band keeps what each text meets within bounds."""
    return min(max(SLOPES), ROWS + max(0, math.ceil(math.log(max(texts, 1) / SETS, STEP))))


def lines(columns: int, rows: int) -> np.ndarray:
    """The samples of each band, ``SLOPES[rows] * columns`` bands: lines through a grid of samples, each sample on
    one line of a slope; two lines share at most one sample (where ``SLOPES[rows] * rows <= columns``)."""
    return np.array([[j * columns + (c + slope * j) % columns for j in range(rows)] for slope in range(SLOPES[rows]) for c in range(columns)])


def sketch_rows(df: DataFrame, key: str, text: str, shares: Shares, n: int, bands: int, rows: int) -> DataFrame:
    """``(id, k1, k2, s1..s8, bands)``: for each text with shingles the 128-bit key of its shingle set, a
    sketch of four bits of each of its first 128 samples and its band keys, one for each of ``lines``.
    ``k1`` also numbers the set."""
    sent = df.sparkSession.sparkContext.broadcast(shares)
    sketched, places = sketched_samples(bands, rows), lines(bands, rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = U64(1) << (np.arange(sketched, dtype=U64) % U64(64))
        half = sketched // 2
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE):
                h, doc, times = shingles(texts[lo:hi], n)
                if not len(h):
                    continue
                sign, which = signatures(h, doc, times, sent.value, bands * rows)
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                k1, k2 = mix(np.add.reduceat(h, first)), mix(np.add.reduceat(mix(h ^ MIX_A), first))
                ones = [((sign[:, :sketched] >> U64(place)) & U64(1)) * bit for place in range(len(SKETCH) // 2)]
                sketch = [x[:, part].sum(axis=1, dtype=U64) for x in ones for part in (slice(half), slice(half, None))]
                band = np.zeros((len(which), len(places)), dtype=U64)
                for r in range(rows):
                    band = band * MIX_A + sign[:, places[:, r]]
                band = mix(band + np.arange(len(places), dtype=U64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(which + lo)), *map(_signed, (k1, k2, *sketch)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * len(places)), _signed(band.ravel())),
                    ],
                    names=["id", "k1", "k2", *SKETCH, "bands"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"id {kind}, k1 bigint, k2 bigint, {' bigint, '.join(SKETCH)} bigint, bands array<bigint>")


def sketched_samples(bands: int, rows: int) -> int:
    """How many of the samples a sketch holds."""
    return min(128, bands * rows)


def _differ(a: str, b: str, sketch: tuple[str, ...]) -> Column:
    """In how many samples two sketches differ, by those of their bits that ``sketch`` names."""
    other = [[F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")) for s in sketch[half::2]] for half in (0, 1)]
    return sum((F.bit_count(reduce(Column.bitwiseOR, x)) for x in other), F.lit(0))


def most_differing(samples: int, similarity: float, bits: int, deviations: float) -> int:
    """Samples in which two sketches of pairs of this weighted Jaccard differ at most, but for so many standard
    deviations: a sample that is not shared has the same ``bits`` bits once in 2 ** ``bits``."""
    apart = (1 - similarity) * (1 - 0.5**bits)
    return math.ceil(samples * apart + deviations * math.sqrt(samples * apart * (1 - apart)))


def verified(pairs: DataFrame, shares: Shares, n: int, threshold: float, exact: float | None = None) -> DataFrame:
    """Those of ``(ka, kb, text_a, text_b)`` whose weighted Jaccard reaches ``threshold`` and, if ``exact`` is
    given, whose Jaccard as sets of shingles reaches that, with both."""
    sent = pairs.sparkSession.sparkContext.broadcast(shares)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            for lo, hi in slices([x + y for x, y in zip(a, b)], SLICE):
                m = hi - lo
                h, doc, times = shingles([*a[lo:hi], *b[lo:hi]], n)
                pair = doc % m
                order = np.lexsort((h, pair))
                h, pair, times = h[order], pair[order], times[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])
                at = np.flatnonzero(new)
                idf, of = sent.value.idf(h[at]), pair[at]
                both = np.diff(np.append(at, len(h))) == 2
                sums = [np.bincount(of, x, minlength=m) for x in (both, idf * np.maximum.reduceat(times, at), idf * np.where(both, np.minimum.reduceat(times, at), 0))] if len(at) else [np.zeros(m)] * 3
                jaccard = sums[0] / np.maximum(np.bincount(of, minlength=m), 1)
                weighted = sums[2] / np.maximum(sums[1], 1e-12)
                keep = np.flatnonzero((weighted >= threshold - 1e-9) & (jaccard >= (exact or 0)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(keep + lo)) for i in (0, 1)), pa.array(jaccard[keep]), pa.array(weighted[keep])],
                    names=["ka", "kb", "jaccard", "weighted_jaccard"],
                )

    return pairs.select("ka", "kb", "text_a", "text_b").mapInArrow(run, "ka bigint, kb bigint, jaccard double, weighted_jaccard double")


class NearDuplicates:
    """Links between texts of ``df`` whose weighted Jaccard over TF-IDF shingles of ``n`` words is ``threshold`` or
    more and, if ``exact`` is given, whose Jaccard as sets of shingles is at least that.

    ``members`` is ``(id, k1)``: each id once with the number of its shingle set; ``links`` is
    ``(ka, kb, jaccard, weighted_jaccard)`` between different sets. Null, empty and shorter texts have no
    shingles and take no part. Rows repeated under one id count once; where their texts differ the id
    belongs to each of their sets. Null ids are dropped. Other columns are ignored; an empty table gives
    empty results. Texts of one shingle set are one member, the one of the smallest id stands for it.

    Candidates come from a self-join on band keys; a pair is passed on only where the two sketches differ
    in at most as many samples as those of pairs at ``threshold`` do (``most_differing``), by two bits a sample in
    the join and by all four after it, so that a band key many unlike texts share sends next to nothing and texts
    are fetched and compared for hardly any but true pairs. Bands get longer with the number of rows (``band_rows``,
    unless ``rows`` is given) and more, so unlike texts do not come to meet in most of them; they are joined in
    portions. Equal sets are joined as one, so copies never meet in a band; a band that many different texts share
    is split by the skew join of the adaptive plan.
    """

    def __init__(self, df: DataFrame, key: str = "id", text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, exact: float | None = None, bands: int = BANDS, rows: int | None = None):
        if not 0 < threshold <= 1 or rows not in (None, *SLOPES):
            raise ValueError(f"threshold must be in (0, 1], rows one of {tuple(SLOPES)}")
        df = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
        self.shares = document_shares(df, text, n)
        rows = rows or band_rows(df.count())
        sketched = cut(sketch_rows(df, key, text, self.shares, n, bands, rows))
        self.members = sketched.select("id", "k1").distinct()
        sets = sketched.groupBy("k1").agg(F.min_by(F.struct("id", *SKETCH), "id").alias("x")).select("k1", "x.*")
        self.sets = sets
        samples, total = sketched_samples(bands, rows), len(lines(bands, rows))
        found, portion = [], AT_ONCE if total <= AT_ONCE else AT_ONCE // 2
        for lo in range(0, total, portion):
            if found:
                release(df)
            part = sketched.select("k1", "id", *CARRIED, F.slice("bands", lo + 1, portion).alias("bands"))
            part = part.groupBy("k1").agg(F.min_by(F.struct(*CARRIED, "bands"), "id").alias("x")).select("k1", "x.*")
            banded = part.select("k1", *CARRIED, F.explode("bands").alias("band"))
            a, b = banded.alias("a"), banded.alias("b")
            near = _differ("a", "b", CARRIED) <= most_differing(samples, threshold, 2, 3.0)
            found.append(
                cut(
                    a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.k1") < F.col("b.k1")) & near)
                    .select(F.col("a.k1").alias("ka"), F.col("b.k1").alias("kb"))
                    .distinct()
                )
            )
        met = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).distinct()
        near = _differ("a", "b", SKETCH) <= most_differing(samples, threshold, len(SKETCH) // 2, 4.0)
        whole = sets.select("k1", *SKETCH)
        pairs = met.join(whole.alias("a"), F.col("ka") == F.col("a.k1")).join(whole.alias("b"), F.col("kb") == F.col("b.k1"))
        pairs = cut(pairs.filter(near).select("ka", "kb"))
        wanted = pairs.select(F.explode(F.array("ka", "kb")).alias("k1")).distinct().join(sets.select("k1", "id"), "k1")
        texts = (
            df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id").groupBy("k1").agg(F.min("text").alias("text"))
        )
        texts = cut(texts)
        both = pairs.join(texts.toDF("ka", "text_a"), "ka").join(texts.toDF("kb", "text_b"), "kb")
        self.links = cut(verified(both, self.shares, n, threshold, exact))

    def pairs(self) -> DataFrame:
        """``(id_a, id_b, jaccard, weighted_jaccard)``, id_a < id_b: the links between ids, copies included, so m
        copies give m(m - 1)/2 rows. Where copies are many, take ``groups``, which is one row an id."""
        m = self.members
        linked = self.links.join(m.toDF("x", "ka"), "ka").join(m.toDF("y", "kb"), "kb").select("x", "y", "jaccard", "weighted_jaccard")
        same = m.toDF("x", "k1").join(m.toDF("y", "k1"), "k1").filter("x < y").select("x", "y", F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("weighted_jaccard"))
        ends = F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")
        return linked.unionByName(same).filter("x != y").groupBy(*ends).agg(F.max("jaccard").alias("jaccard"), F.max("weighted_jaccard").alias("weighted_jaccard"))

    def groups(self) -> DataFrame:
        """``(id, group_id, links)``: each id with the smallest id of its connected group and the number of
        other sets its own is linked to; texts without a partner are a group of their own."""
        label = components(self.links.select("ka", "kb"))
        degree = self.links.select(F.explode(F.array("ka", "kb")).alias("k1")).groupBy("k1").count()
        of = self.members.join(label.toDF("k1", "root"), "k1", "left").join(degree, "k1", "left")
        of = of.select("id", F.coalesce("root", "k1").alias("root"), F.coalesce("count", F.lit(0)).alias("links"))
        return of.join(of.groupBy("root").agg(F.min("id").alias("group_id")), "root").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` of the graph of ``edges`` (two columns): alternating large-star and small-star
    steps, each round written to the checkpoint folder, until nothing changes."""
    a, b = edges.columns
    now = cut(edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter("low != high").distinct())
    for _ in range(rounds):
        both = now.union(now.select("high", "low")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        large = both.filter("other > node").join(least, "node").select(F.col("least").alias("low"), F.col("other").alias("high")).filter("low != high").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high")
        small = small.select(F.col("least").alias("low"), "high").union(small.select(F.col("least").alias("low"), F.col("low").alias("high"))).filter("low != high").distinct()
        after = cut(small)
        same = after.count() == now.count() and after.join(now, ["low", "high"], "left_anti").isEmpty()
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"groups did not settle in {rounds} rounds")
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).union(now.select("low", "low").distinct())
