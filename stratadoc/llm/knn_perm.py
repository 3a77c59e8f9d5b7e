"""Most similar vectors of every vector by a permutation index of two levels.

Every vector is represented by its nearest pivots in order and posted in the inverted files of those
pivots. A query's candidates are the vectors it meets in the inverted files of its own pivots; the
closest ones by footrule distance between the two orders are ranked again by their cosine.

The pivots of the upper level, a sample of all vectors, only decide where to look: neighbouring pivots
form groups, a vector lives in the group of its nearest pivot and is shipped as a query to the next
groups in its order, to more of them the more groups there are. A pair found from one side counts for both, so it is
missed only if neither visits the other. Where the rows are more than the upper pivots can divide, each group is halved as often
as needed by planes through its middle, and a query goes to the nearest other sides as well. Each group
has pivots and inverted files of its own, one pivot for every few of its vectors, so the index is as fine in a
large collection as in a small one. Pivots are sampled, so dense regions hold more of them, and groups and
inverted files stay of one size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadoc.llm.wordscan import MIX_A, U64, mix
from stratadoc.session import cut, release

NEAREST = 5
#: Upper pivots are PIVOTS_ROOT times the square root of the rows, at most MOST_PIVOTS (a broadcast of 32 MB at 1,024 dimensions).
PIVOTS_ROOT, MOST_PIVOTS = 6, 8192
#: How many of its nearest upper pivots a vector follows, to how many groups at most, for up to FEW_GROUPS groups.
FOLLOWED, VISITS, FEW_GROUPS = 8, 3, 32
#: For twice as many groups a vector visits one more, and follows so many more pivots for it.
MORE_FOLLOWED = 5
GROUP_ROWS = 4000
#: Planes whose other side a query visits too in its own group, the nearest ones.
OTHER_SIDES = 2
#: A group has a pivot for every PER_PIVOT vectors.
PER_PIVOT = 4
ORDER = 12
RERANKED = 48


def _dense(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a batch, and the vectors: not null, of ``dim`` numbers (any length
    but the same if None), all finite, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    ok = np.asarray(column.is_valid()) & (sizes > 0)
    if dim:
        ok &= sizes == dim
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.zeros((0, dim or 1), dtype=np.float32)
    dim = dim or int(sizes[at[0]])
    at = at[sizes[at] == dim]
    values = column.values.to_numpy(zero_copy_only=False)
    x = values[column.offsets.to_numpy()[at][:, None] + np.arange(dim)].astype(np.float32)
    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return at[good], x[good]


def _class(x: np.ndarray) -> np.ndarray:
    """A 64-bit number of each vector's exact value; -0 counts as 0."""
    bits = np.ascontiguousarray(x + np.float32(0)).view(np.uint32).astype(U64)
    factor = mix(np.arange(1, x.shape[1] + 1, dtype=U64) * MIX_A) | U64(1)
    return mix((bits * factor).sum(axis=1, dtype=U64)).view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def pivot_groups(pivots: np.ndarray, groups: int) -> np.ndarray:
    """A group for each pivot: halves along the direction of largest spread, until there are ``groups``."""
    out = np.zeros(len(pivots), dtype=np.int32)
    todo = [(np.arange(len(pivots)), groups)]
    number = 0
    while todo:
        at, n = todo.pop()
        if n <= 1 or len(at) < 2:
            out[at] = number
            number += 1
            continue
        x = pivots[at] - pivots[at].mean(axis=0)
        v = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(12):
            v = (v @ x.T) @ x
            v /= np.linalg.norm(v) or 1
        order = at[np.argsort(x @ v, kind="stable")]
        half = len(order) * (n // 2) // n
        todo += [(order[:half], n // 2), (order[half:], n - n // 2)]
    return out


def halves(groups: int, rows: int, group_rows: int) -> int:
    """How often each group must be halved for about ``group_rows`` rows in each part."""
    return max(0, math.ceil(math.log2(max(1.0, rows / (groups * group_rows)))) if rows > 2 * groups * group_rows else 0)


def reach(groups: int) -> tuple[int, int]:
    """How many upper pivots a vector follows among so many groups, and how many groups it visits."""
    more = max(0, math.ceil(math.log2(max(groups, 1) / FEW_GROUPS)))
    return FOLLOWED + MORE_FOLLOWED * more, VISITS + more


def sides(x: np.ndarray, group: np.ndarray, middles: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of its group each vector is in, a bit for each of ``planes`` random planes through the group's middle,
    and its distance from them."""
    normal = np.random.default_rng(11).normal(size=(planes, x.shape[1])).astype(np.float32)
    apart = (x - middles[group]) @ normal.T
    return ((apart > 0) << np.arange(planes)).sum(axis=1), np.abs(apart)


def orders(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest pivots of each unit vector, nearest first."""
    out = []
    for lo in range(0, len(x), 1024):
        near = x[lo : lo + 1024] @ pivots.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(pivots) else np.broadcast_to(np.arange(k), near.shape)
        rank = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(top, rank, 1).astype(np.int32))
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int32)


def _pack(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, the bytes of equal weight side by side, compressed without loss."""
    import zstandard

    write = zstandard.ZstdCompressor(level=1).compress
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1))
    return [write(p.tobytes()) for p in planes]


def _unpack(packed: Iterable[bytes]) -> np.ndarray:
    import zstandard

    read = zstandard.ZstdDecompressor().decompress
    planes = np.stack([np.frombuffer(read(p), dtype=np.uint8).reshape(4, -1) for p in packed])
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.float32)[..., 0]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def neighbours(q: np.ndarray, x: np.ndarray, q_order: np.ndarray, x_order: np.ndarray, same: np.ndarray, k: int, reranked: int, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, vector, cosine)`` of the best ``k`` vectors of ``x`` for each query and those like the last of them,
    itself (at ``same``) left out.

    With orders of length K, the footrule distance with absent pivots at rank K is
    K(K+1) - 2 sum(min(K - rank in one, K - rank in the other)) over the pivots they share, so it is added
    up along the inverted files; vectors without a shared pivot are never touched. Candidates are ranked by
    the product of ``q`` and ``x``, which are unit vectors; ``exact`` gives the cosines of the best, by their
    places, from the vectors as they are.
    """
    length = q_order.shape[1]
    post = x_order.ravel()
    by_pivot = np.argsort(post, kind="stable")
    holder, room = by_pivot // length, (length - by_pivot % length).astype(np.int32)
    sizes = np.bincount(post, minlength=int(max(post.max(), q_order.max())) + 1)
    start = np.cumsum(sizes) - sizes
    out = []
    step = max(1, min(256, (1 << 21) // len(x)))
    for lo in range(0, len(q), step):
        part = q_order[lo : lo + step]
        m = len(part)
        pivot = part.ravel()
        n = sizes[pivot]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[pivot], n)
        query = np.repeat(np.repeat(np.arange(m), length), n)
        own = np.repeat(np.tile(length - np.arange(length, dtype=np.int32), m), n)
        shared = np.bincount(query * len(x) + holder[entry], np.minimum(own, room[entry]), minlength=m * len(x)).reshape(m, len(x))
        footrule = length * (length + 1) - 2 * shared
        footrule[shared == 0] = np.inf
        mine = same[lo : lo + step]
        footrule[np.flatnonzero(mine >= 0), mine[mine >= 0]] = np.inf
        best = np.argpartition(footrule, min(reranked, len(x)) - 1, axis=1)[:, :reranked]
        usable = np.isfinite(np.take_along_axis(footrule, best, 1))
        near = np.matmul(x[best], q[lo : lo + step, :, None])[..., 0]
        near[~usable] = -np.inf
        last = -np.sort(-near, axis=1)[:, min(k, near.shape[1]) - 1]
        row, col = np.nonzero((near >= (last - 2e-6)[:, None]) & np.isfinite(near))
        vector = best[row, col]
        out.append((lo + row, vector, exact(lo + row, vector)))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def most_similar(df: DataFrame, key: str = "id", vector: str = "vector", k: int = NEAREST, dim: int | None = None, order: int = ORDER, reranked: int = RERANKED, group_rows: int = GROUP_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: for every id with a usable vector its ``k`` most similar others.

    Every row is indexed and every row is a query. Vectors that are null, of another length than ``dim``
    (by default the most frequent length), not finite or all zero take no part, nor do null ids; repeated
    rows of an id count once. Equal cosines (to nine decimals) are ranked by the smaller id. Equal vectors
    are one member of the index, so a value any number of rows share is handled once; their ids come back
    at the end. Of vectors of one direction but different lengths up to ``reranked`` are told apart. Fewer than ``k`` others give fewer rows, an empty table none. Other columns are ignored.
    """
    df = df.select(F.col(key).alias("id"), F.col(vector).alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    kind = df.schema["id"].dataType.simpleString()
    if dim is None:
        lengths = df.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = lengths.n if lengths else 1
    spark, rows = df.sparkSession, df.count()
    wanted = min(most_pivots, math.ceil(PIVOTS_ROOT * math.sqrt(max(rows, 1))))
    bits = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    sample = df.filter(bits < int((1 << 40) * min(1.0, wanted / max(rows, 1)))).select("vector").toArrow()
    _, drawn = _dense(sample.column(0), dim) if sample.num_rows else (None, np.zeros((0, dim), dtype=np.float32))
    pivots = _unit(drawn[np.unique(_class(drawn), return_index=True)[1]]) if len(drawn) else drawn
    if not len(pivots):
        pivots = np.eye(1, dim, dtype=np.float32)
    pivots = pivots[: 2 * most_pivots]
    groups = max(1, min(len(pivots), rows // group_rows))
    group_of = pivot_groups(pivots, groups)
    groups = int(group_of.max()) + 1
    middles = np.stack([pivots[group_of == g].mean(axis=0) for g in range(groups)])
    planes = halves(groups, rows, group_rows)
    followed, visited = reach(groups)
    followed = min(followed, len(pivots))
    rounds = 1 if visited <= VISITS else math.ceil((visited + min(planes, OTHER_SIDES)) / 2)
    sent = spark.sparkContext.broadcast((pivots, group_of, middles))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _dense(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(_class(x))], names=["id", "class"])

    def ship(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, group_of, middles = sent.value
        seen: set[int] = set()
        for batch in batches:
            _, every = _dense(batch.column(0), dim)
            classes = _class(every)
            fresh = []
            for i, c in enumerate(classes.tolist()):
                if c not in seen:
                    seen.add(c)
                    fresh.append(i)
            for lo in range(0, len(fresh), 512):
                at = fresh[lo : lo + 512]
                x = _unit(every[at])
                packed, number = _pack(every[at]), classes[at]
                visits = [list(dict.fromkeys(v))[:visited] for v in group_of[orders(x, pivots, followed)].tolist()]
                if planes:  # the group of each visit is the part of it the vector is in, and that of its own the nearest other sides too
                    row = np.repeat(np.arange(len(at)), [len(v) for v in visits])
                    group, home = np.array([g for v in visits for g in v], dtype=np.int64), np.array([j == 0 for v in visits for j in range(len(v))])
                    part, apart = sides(x[row], group, middles, planes)
                    near = np.argsort(apart[home], axis=1)[:, :OTHER_SIDES]
                    others = (group[home] << planes)[:, None] + (part[home][:, None] ^ (1 << near))
                    inside = np.split((group << planes) + part, np.flatnonzero(home)[1:])
                    visits = [[*a.tolist(), *b.tolist()] for a, b in zip(inside, others)]
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(packed, pa.binary()), pa.array(visits, pa.list_(pa.int64()))], names=["class", "packed", "groups"])

    def search(table: pa.Table) -> pa.Table:
        number = table.column("class").to_numpy()
        home = table.column("home").to_numpy()
        _, first = np.unique(number, return_index=True)  # copies from several partitions
        number, home = number[first], home[first]
        table = table.take(pa.array(first))
        raw = _unpack(p.as_py() for p in table.column("packed"))
        every = _unit(raw)
        live = np.flatnonzero(home)
        if not len(live):
            return pa.table({"query": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        place = np.full(len(number), -1)
        place[live] = np.arange(len(live))
        local = every[live[: -(-len(live) // PER_PIVOT)]]  # in order of class number, so at random
        near = orders(every, local, min(order, len(local)))
        exact = lambda q, x: _cosines(raw[q], raw[live[x]])
        a, b, near = neighbours(every, every[live], near, near[live], place, k, reranked, exact)
        return pa.table({"query": pa.array(number[a]), "class": pa.array(number[live][b]), "cosine": pa.array(near)})

    members = cut(df.mapInArrow(number, f"id {kind}, class bigint").distinct())
    shipped = df.select("vector").mapInArrow(ship, "class bigint, packed binary, groups array<bigint>")
    best = Window.partitionBy("query").orderBy(F.round("cosine", 9).desc())
    if rounds > 1:
        shipped = cut(shipped)
    near = None
    for r in range(rounds):  # a round takes a part of the groups, so what is shuffled at a time does not grow with the visits
        if r:
            release(df)
        copies = shipped.select("class", "packed", F.posexplode("groups").alias("place", "group")).withColumn("home", F.col("place") == 0)
        copies = copies.filter(F.pmod("group", F.lit(rounds)) == r).select("group", "home", "class", "packed")
        found = copies.groupBy("group").applyInArrow(search, "query bigint, class bigint, cosine double")
        ends = (F.struct(F.col(a).alias("query"), F.col(b).alias("class"), "cosine") for a, b in (("query", "class"), ("class", "query")))
        found = found.select(F.explode(F.array(*ends)).alias("x")).select("x.*")
        found = (found if near is None else near.unionByName(found)).repartition("query").dropDuplicates(["query", "class"])
        near = found.withColumn("n", F.rank().over(best)).filter(F.col("n") <= k).drop("n")
        if rounds > 1:
            near = cut(near)
    by_id = Window.partitionBy("class").orderBy("id")
    first_ids = members.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1).drop("n").withColumnRenamed("id", "neighbour")
    own = first_ids.select(F.col("class").alias("query"), F.lit(1.0).alias("cosine"), "neighbour")
    ranked = near.join(first_ids, "class").select("query", F.round("cosine", 9).alias("cosine"), "neighbour").unionByName(own)
    rank = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    ranked = ranked.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= k + 1).drop("n")
    of = members.withColumnRenamed("class", "query").join(ranked, "query").filter("id != neighbour")
    rank = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return of.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")


def neighbour_pairs(nearest: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b, of ids of which at least one is among the nearest of the other."""
    return nearest.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
