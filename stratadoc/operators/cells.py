"""Approximate vector search in the core: rows are dealt into cells around centres, a query looks into the nearest cells.

Exact search (``search.nearest_to_each``) costs queries times rows. Here each query meets only the rows of ``probes``
cells, with about the root of the rows in each; recall is a matter of ``probes``. Every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stratadoc.operators.search import PART_ROWS, _best, _by_width
from stratadoc.session import cut

#: Rows the centres are fitted on at most, cells at most (16 MB of centres at 1,024 numbers), and steps of fitting.
SAMPLE, CELLS, STEPS = 50_000, 4096, 6
#: Cell of vectors of another length than the centres; it is searched whole by queries of such a length.
OTHER = -1


def centres_of(x: np.ndarray, cells: int, steps: int = STEPS, seed: int = 5) -> np.ndarray:
    """Centres of ``cells`` groups of the rows of ``x``, by Lloyd's steps from a sample; empty groups keep their centre."""
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(steps):
        cell = nearest_cells(x, centres, 1)[:, 0]
        count = np.bincount(cell, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    out, n = [], min(n, len(centres))
    for lo in range(0, len(x), 2048):
        apart = (centres * centres).sum(1) - 2 * x[lo : lo + 2048] @ centres.T
        some = np.argpartition(apart, n - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(apart, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), dtype=np.int64)


class CellIndex:
    """Rows of ``df`` with their cells. A cell of more than ``PART_ROWS`` rows is several parts, so that one with a
    third of all rows is many tasks. Null, empty and not finite vectors are left out; an empty table has no cells."""

    def __init__(self, df: DataFrame, key: str = "id", vector: str = "vector", facets: tuple[str, ...] = (), cells: int | None = None, sample: int = SAMPLE):
        self.key, self.vector, self.facets = key, vector, facets
        usable = df.select(key, vector, *facets).filter(F.size(vector) > 0)
        sizes = usable.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").collect()
        total = sum(r["count"] for r in sizes)
        self.width = sizes[0].n if sizes else 1
        wanted = int((1 << 30) * min(1.0, sample / max(total, 1)))
        drawn = usable.filter((F.size(vector) == self.width) & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < wanted)).select(vector).toArrow()
        x = _by_width(drawn.column(0)).get(self.width, (None, np.zeros((0, self.width))))[1] if drawn.num_rows else np.zeros((0, self.width))
        if not len(x):
            x = np.zeros((1, self.width))
        self.centres = centres_of(x, min(cells or math.ceil(math.sqrt(max(total, 1))), CELLS))
        placed = cut(self._placed(usable, 1))
        count = placed.groupBy("_cell").agg(F.greatest(F.ceil(F.count("*") / PART_ROWS), F.lit(1)).cast("int").alias("_parts"))
        self.parts = cut(count)
        self.rows = placed.join(self.parts, "_cell").withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts")

    def _placed(self, df: DataFrame, n: int) -> DataFrame:
        """Rows of ``df``, whose second column is a vector, for each of their ``n`` nearest cells."""
        sent, width = df.sparkSession.sparkContext.broadcast(self.centres), self.width

        def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, cell = [], []
                for size, (at, x) in _by_width(batch.column(1)).items():
                    near = nearest_cells(x, sent.value, n) if size == width else np.full((len(at), 1), OTHER)
                    row.append(np.repeat(at, near.shape[1]))
                    cell.append(near.ravel())
                rows = np.concatenate([np.zeros(0, dtype=np.int64), *row])
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *cell]).astype(np.int32))], names=[*batch.schema.names, "_cell"])

        return df.mapInArrow(place, T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType())]))

    def search(self, queries: DataFrame, n: int, probes: int = 8, query_id: str | None = None) -> DataFrame:
        """``(query_id, key, distance, rank)`` as ``nearest_to_each`` gives them, from the ``probes`` nearest cells of
        each query. Without ``query_id`` the queries are rows of the index and no row is its own neighbour."""
        others, query_id, f = query_id is None, query_id or self.key, len(self.facets)
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(self.vector).alias("_vector"), *(F.col(f"filter_{x}") for x in self.facets)).filter(F.size("_vector") > 0)
        schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField(self.key, self.rows.schema[self.key].dataType), T.StructField("distance", T.DoubleType())])
        kinds, names = [to_arrow_type(schema[i].dataType) for i in (0, 1)], schema.names
        sent = self._placed(asked, probes).join(self.parts, "_cell").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        left, right = self.rows.select(self.key, self.vector, *self.facets, "_cell", "_part"), sent.select("query_id", "_vector", *(f"filter_{x}" for x in self.facets), "_cell", "_part")

        def meet(rows: pa.Table, asking: pa.Table) -> pa.Table:
            if not rows.num_rows or not asking.num_rows:
                return pa.table([pa.array([], k) for k in (*kinds, pa.float64())], names=names)
            return _best(asking.drop_columns(["_cell", "_part"]), rows.drop_columns(["_cell", "_part"]).to_batches(), n, f, others, names, kinds)

        found = left.groupBy("_cell", "_part").cogroup(right.groupBy("_cell", "_part")).applyInArrow(meet, schema)
        rank = Window.partitionBy("query_id").orderBy("distance", self.key)
        return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)
