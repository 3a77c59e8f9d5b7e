"""Texts put into token containers by variable-capacity best fit over the histogram of their lengths.

The plan is made on the histogram (one count per length up to the capacity, so bounded whatever the
number of texts): patterns of lengths that fill a container, each with the number of times it is used.
Texts then find their container by their rank among the texts of equal length, in one sorted pass and
without any of them being gathered in one place.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.session import cut

CAPACITY = 2048
#: Lengths a container may have in the end.
SIZES = (256, 512, 1024, 2048)
#: Room that opening one more container costs, in tokens.
OPENING = 8
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    """The encoder of a public byte-level vocabulary, from the contents of its file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    # fixed value: the split pattern published with this vocabulary
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary(folder: str = TOKENIZERS) -> bytes:
    with open(f"{folder}/{VOCABULARY}", "rb") as f:
        return f.read()


def token_counts(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, n_tokens)``; null and empty texts have 0 tokens. The driver reads the vocabulary, about a
    megabyte, and sends it to the workers."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary(folder))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(sent.value).encode_ordinary
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())],
                names=["doc_id", "n_tokens"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint")


#: Ways to fill a container: the longest length that fits, again and again, which is first-fit decreasing; the
#: same, but one or two lengths that fit exactly before it; the best sum of different lengths.
WAYS = ("longest", "exact", "sums")


def _fill(room: int, counts: np.ndarray, way: str) -> list[int]:
    """Lengths still in ``counts`` for ``room``; of equal sums the one with the longest lengths."""
    left, out = counts[: room + 1].copy(), []
    while room > 0:
        if left[room] > 0:
            return [*out, room]
        if way != "longest":
            a = np.arange(1, room // 2 + 1)
            pair = a[(left[a] > 0) & (left[room - a] > np.where(2 * a == room, 1, 0))]
            if len(pair):
                return [*out, room - int(pair[-1]), int(pair[-1])]
        lengths = np.flatnonzero(left[: room + 1] > 0)
        if not len(lengths):
            return out
        if way == "sums":
            return [*out, *_best_sum(room, lengths.tolist())]
        n = int(lengths[-1])
        times = min(int(left[n]), room // n) if way == "longest" else 1
        out += [n] * times
        left[n] -= times
        room -= n * times
    return out


def _best_sum(room: int, lengths: list[int]) -> list[int]:
    """Different lengths with the largest sum up to ``room``."""
    within = (1 << (room + 1)) - 1
    sums = [1]  # bit s of sums[i]: the first i lengths can make the sum s
    for n in lengths:
        sums.append(sums[-1] | (sums[-1] << n) & within)
    at, used = sums[-1].bit_length() - 1, []
    for i in range(len(lengths) - 1, -1, -1):
        n = lengths[i]
        if n <= at and sums[i] >> (at - n) & 1:
            used.append(n)
            at -= n
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, sizes: tuple[int, ...] = SIZES, opening: int = OPENING) -> list[tuple[list[int], int, int]]:
    """``(lengths, size, times)``: patterns with the container size each ends in and how often it is used.

    Of the ``WAYS`` to fill a container the one that leaves least room unused is taken, of equal ones that with
    fewest containers; so the result is never worse than first-fit decreasing with its containers downsized.
    """
    plans = [_plan(histogram, capacity, sizes, opening, way) for way in WAYS]
    plans.append(_plan(histogram, capacity, (capacity,), opening, WAYS[0], sizes))
    return min(plans, key=lambda p: (sum(s * t for _, s, t in p), sum(t for *_, t in p)))


def _plan(histogram: dict[int, int], capacity: int, sizes: tuple[int, ...], opening: int, way: str, final: tuple[int, ...] | None = None) -> list[tuple[list[int], int, int]]:
    """The longest length left opens a container. Every permitted size that holds it is tried and filled
    from what is left; the one of least cost, unused room plus ``opening``, for each token it holds is
    taken, and ends in the smallest size, of ``final`` if given, that holds its contents.
    """
    ends = sorted({s for s in final or sizes if s <= capacity} | {capacity})
    permitted = sorted({s for s in sizes if s <= capacity} | {capacity})
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in histogram.items():
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} is outside 1..{capacity}")
        counts[n] += k
    out = []
    while (top := int(np.flatnonzero(counts)[-1]) if counts.any() else 0):
        best = None
        counts[top] -= 1
        for size in permitted:
            if size >= top:
                content = [top, *_fill(size - top, counts, way)]
                held = sum(content)
                cost = (size - held + opening) / held
                if best is None or cost <= best[0]:
                    best = (cost, content, held)
        counts[top] += 1
        content, held = best[1], best[2]
        need = np.bincount(content, minlength=capacity + 1)
        times = int((counts[need > 0] // need[need > 0]).min())
        counts -= need * times
        out.append((content, next(s for s in ends if s >= held), times))
    return out


def pack(documents: DataFrame, capacity: int = CAPACITY, sizes: tuple[int, ...] = SIZES, folder: str = TOKENIZERS, opening: int = OPENING) -> DataFrame:
    """``(doc_id, part, n_tokens, container, container_size)``: the container of each text.

    A text is split only if it alone exceeds ``capacity``: into parts of ``capacity`` tokens and the rest,
    numbered from 0. Texts without tokens (null, empty) take no room and go to container 0. Repeated rows
    are packed each on its own; equal lengths are taken in order of ``doc_id``, nulls first, whatever the
    number of texts. Other columns are ignored; an empty table gives an empty result. ``container_size`` is
    the smallest permitted length that holds the container's contents.

    Items are sorted over all partitions by length and id; the driver gets a count for each length and
    partition, at most ``capacity`` more than there are partitions, since each follows the one before.
    """
    counted = token_counts(documents, folder)
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = F.col("n_tokens") % capacity
    lengths = F.concat(F.array_repeat(F.lit(capacity).cast("long"), full), F.when((rest > 0) | (full == 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    items = cut(counted.select("doc_id", F.posexplode(lengths).alias("part", "n_tokens")))
    order = ["n_tokens", "doc_id", "part"]
    items = cut(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    offsets: dict[tuple[int, int], int] = {}
    histogram: dict[int, int] = {}
    for r in items.groupBy("n_tokens", "pid").count().orderBy("n_tokens", "pid").collect():
        offsets[r["pid"], r["n_tokens"]] = histogram.get(r["n_tokens"], 0)
        histogram[r["n_tokens"]] = histogram.get(r["n_tokens"], 0) + r["count"]
    histogram.pop(0, None)

    steps, container = [], 0
    used: dict[int, int] = {}
    first_size = capacity
    for content, size, times in plan(histogram, capacity, sizes, opening):
        if container == 0:
            first_size = size
        for n in set(content):
            k = content.count(n)
            steps.append((n, used.get(n, 0), container, k, size))
            used[n] = used.get(n, 0) + k * times
        container += times
    steps.sort()
    length, start, base, each, size = (np.array([s[i] for s in steps], dtype=np.int64) for i in range(5))
    key = length * (1 << 44) + start
    empty_size = first_size if steps else min({*sizes, capacity})

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = -1, 0  # the length a batch ended with, and how many of it there were
        for batch in batches:
            n, pid = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            if not len(n):
                continue
            begin = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
            count = np.diff(np.append(begin, len(n)))
            base_rank = np.array([offsets[int(pid[i]), int(n[i])] for i in begin], dtype=np.int64)
            base_rank[0] += done if n[0] == last else 0
            rank = np.repeat(base_rank - begin, count) + np.arange(len(n))
            done = int(count[-1]) + (done if len(begin) == 1 and n[0] == last else 0)
            last = int(n[-1])
            at, big = np.zeros(len(n), dtype=np.int64), np.full(len(n), empty_size)
            some = n > 0
            if some.any():
                s = np.searchsorted(key, n[some] * (1 << 44) + rank[some], side="right") - 1
                at[some] = base[s] + (rank[some] - start[s]) // each[s]
                big[some] = size[s]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(at), pa.array(big.astype(np.int32))],
                names=["doc_id", "part", "n_tokens", "container", "container_size"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return items.select("doc_id", "part", "n_tokens", "pid").mapInArrow(place, f"doc_id {kind}, part int, n_tokens bigint, container bigint, container_size int")
