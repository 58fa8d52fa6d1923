"""A cell index of chunk vectors: exact cosine top-k that reads only cells a bound cannot rule out.

Vectors are laid out by cell, the nearest of some centroids, in partitions of
their own; of each cell the greatest angle between its centroid and a member is
kept. A member can be no nearer to a query than the angle from the query to the
centroid less that one. A search first reads the most promising cells of each
query, which gives the score that its list cannot fall below, and then those of
the other cells whose bound reaches it. Spark prunes the partitions of all
others. Scores, ties and odd vectors come out as in ``similarity.top_k``, whose
arithmetic and ranking this uses.

Centroids are learned on a sample of ``SAMPLE`` vectors a cell, drawn by a hash
of the keys; every vector is indexed. A length of vectors that the sample lacks
has one cell that is never ruled out. Vectors without a score (null, zero, not
finite) are not in the index, since no search can return them.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaeflow.fixed_values import HITS_PER_QUESTION
from vitaeflow.operators import similarity as S
from vitaeflow.session import BROADCAST_BYTES, cut_lineage

#: Vectors of the sample for each cell, and rounds of learning.
SAMPLE, ROUNDS = 64, 8
#: Cells that a query reads first.
FIRST = 2
#: What angles may be off by, and rounded scores.
_ANGLE, _SCORE = 1e-6, 2e-9


def _name(dimension: int, number: int) -> str:
    return f"{dimension}_{number}"


def _learned(blocks: list, cells: int) -> dict:
    """Centroids by vector length: unit vectors that sample vectors gather round, more for lengths with more of them."""
    import numpy as np

    total = sum(len(matrix) for _, matrix in blocks)
    made = {}
    for _, matrix in blocks:
        matrix = matrix.astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        usable = np.isfinite(norms) & (norms > 0)
        unit = np.unique(matrix[usable] / norms[usable, None], axis=0)
        if not len(unit):
            continue
        n = min(len(unit), max(1, round(cells * len(matrix) / total)))
        centroids = unit[np.random.default_rng(42).permutation(len(unit))[:n]]
        for _ in range(ROUNDS):
            nearest = (unit @ centroids.T).argmax(1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, unit)
            sizes = np.sqrt((sums**2).sum(1))
            centroids = np.where(sizes[:, None] > 1e-9, sums / np.maximum(sizes, 1e-9)[:, None], centroids)
        made[unit.shape[1]] = centroids
    return made


def _placed(rows: DataFrame, vector: str, centroids: dict) -> DataFrame:
    """``rows`` that can be scored, with ``cell`` and the ``angle`` to its centroid; nothing moves."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.StringType()), T.StructField("angle", T.DoubleType())])
    unit_rows = S._vector_tools()
    name, names = _name, rows.columns

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(vector)
            lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for dimension in np.unique(lengths[lengths > 0]):
                found, unit = unit_rows(vectors, int(dimension))
                known = shared.value.get(int(dimension))
                nearest, angle = np.zeros(len(found), np.int64), np.full(len(found), np.pi)
                if known is not None:
                    near = unit @ known.T
                    nearest = near.argmax(1)
                    angle = np.arccos(np.clip(near[np.arange(len(found)), nearest], -1, 1))
                part = batch.take(pa.array(found))
                cells = pa.array([name(int(dimension), int(i)) for i in nearest], pa.string())
                yield pa.record_batch([*part.columns, cells, pa.array(angle)], names=[*names, "cell", "angle"])

    return rows.mapInArrow(place, schema)


class CellIndex:
    """An index written by ``build``; opening one reads its table of cells."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/layout").first()["schema"]))
        facts = spark.read.parquet(f"{path}/cells").collect()
        #: Cells with their vector length, centroid (if any) and greatest angle.
        self.cells = sorted((r["cell"], int(r["cell"].partition("_")[0]), r["centroid"], r["angle"]) for r in facts)
        self._rows = {r["cell"]: r["n"] for r in facts}
        #: Of each scan: how many cells it read.
        self.visits: list[int] = []
        self._chunks: DataFrame | None = None

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int = 256, keys: list[str] | None = None, vector: str = "vector") -> CellIndex:
        """Index the vectors of ``chunks`` in ``path``: one shuffle by cell, which splits cells that are hot."""
        spark, keys = chunks.sparkSession, keys or ["RUN", "chunk_no"]
        rows = chunks.select(*keys, F.col(vector).alias("vector")).where(F.size("vector") > 0)
        share = min(1.0, SAMPLE * cells / max(1, rows.count()))
        drawn = rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
        centroids = _learned(S._query_blocks(drawn.select(keys[0], "vector"), keys[0]), cells)
        placed = _placed(rows, "vector", centroids)
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/chunks")
        held = spark.read.schema(placed.schema).parquet(f"{path}/chunks")
        centres = {_name(d, i): [float(x) for x in c] for d, rows_ in centroids.items() for i, c in enumerate(rows_)}
        # one row for each cell
        facts = [(r["cell"], centres.get(r["cell"]), r["angle"], r["n"])
                 for r in held.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect()]
        spark.createDataFrame(facts, "cell string, centroid array<double>, angle double, n bigint").write.parquet(f"{path}/cells")
        spark.createDataFrame([(placed.schema.json(),)], "schema string").write.parquet(f"{path}/layout")
        return cls(spark, path)

    def chunks(self) -> DataFrame:
        """The indexed vectors with their keys and ``cell``, which scans are pruned by.

        Its many folders are listed once; nothing changes them after ``build``.
        """
        if self._chunks is None:
            self._chunks = self.spark.read.schema(self.schema).parquet(f"{self.path}/chunks").drop("angle")
        return self._chunks

    def top_k(self, queries: DataFrame, k: int = HITS_PER_QUESTION, query_id: str = "query_id", keys: list[str] | None = None,
              vector: str = "vector", per_candidate: bool = False, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """The rows of ``similarity.top_k`` over the indexed chunks.

        Queries go to the cells that they read, where a task has ``similarity.HELD_BYTES`` of either side. None pass the
        driver, so ``block_bytes``, which bounded those that did, is kept for callers only.
        """
        keys = keys or ["RUN", "chunk_no"]
        asked = S._query_side(queries, query_id, vector)
        first = cut_lineage(self._wanted(asked))
        hits = cut_lineage(self._searched(first, k, query_id, keys, per_candidate))
        ranked = S._rank(hits, k, query_id, keys, per_candidate)
        floors = ranked.where(F.col("rank") == k).select(query_id, F.col("score").alias("_floor"))
        # most of the queries have a floor; those without one read every cell
        second = cut_lineage(self._wanted(first.join(floors, query_id, "left")))
        return S._rank(hits.unionByName(self._searched(second, k, query_id, keys, per_candidate)), k, query_id, keys, per_candidate)

    def _wanted(self, asked: DataFrame) -> DataFrame:
        """Queries that can be scored, with ``_cells``: the most promising ones, or, given those and ``_floor``, the others
        whose bound on their members' scores reaches it."""
        shared, unit_rows = self.spark.sparkContext.broadcast(self.cells), S._vector_tools()
        kept = [f for f in asked.schema.fields if f.name not in ("_cells", "_floor")]
        schema = T.StructType([*kept, T.StructField("_cells", T.ArrayType(T.StringType()))])
        names, later, most, angle, slack = [f.name for f in kept], "_floor" in asked.columns, FIRST, _ANGLE, _SCORE

        def bounds(matrix):
            """For each cell of the vectors' length, the highest score that its members can have with each query."""
            import numpy as np

            mine = [c for c in shared.value if c[1] == matrix.shape[1]]
            made = np.ones((len(matrix), len(mine)))
            known = [i for i, c in enumerate(mine) if c[2] is not None]
            if known:
                centres = np.array([mine[i][2] for i in known])
                angles = np.arccos(np.clip(matrix @ centres.T, -1, 1)) - np.array([mine[i][3] for i in known]) - angle
                made[:, known] = np.cos(np.maximum(angles, 0))
            return [c[0] for c in mine], made

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                vectors = batch.column("vector")
                lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                for dimension in np.unique(lengths[lengths > 0]).tolist():
                    rows, unit = unit_rows(vectors, dimension)
                    cells, reach = bounds(unit)
                    if not len(rows) or not cells:
                        continue
                    part = batch.take(pa.array(rows))
                    if later:
                        floor = part.column("_floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                        read = [set(c) for c in part.column("_cells").to_pylist()]
                        wanted = [[cells[i] for i in np.flatnonzero(line) if cells[i] not in done]
                                  for line, done in zip(reach >= floor[:, None] - slack, read)]
                    else:
                        wanted = [[cells[i] for i in line] for line in np.argsort(-reach, axis=1, kind="stable")[:, :most]]
                    yield pa.record_batch([*(part.column(name) for name in names), pa.array(wanted, pa.list_(pa.string()))],
                                          names=[*names, "_cells"])

        return asked.mapInArrow(run, schema)

    def _searched(self, wanted: DataFrame, k: int, query_id: str, keys: list[str], per_candidate: bool) -> DataFrame:
        """Hits of queries in their ``_cells``; partitions of cells that none wants are not read."""
        pairs = wanted.select(query_id, "vector", F.explode("_cells").alias("cell"))
        # one row for each cell
        asked = {r["cell"]: r["count"] for r in pairs.groupBy("cell").count().collect()}
        self.visits.append(len(asked))
        parts, tasks = [], 0
        cores = self.spark.sparkContext.defaultParallelism
        for cell, _, _, _ in self.cells:
            if cell in asked:
                size = 8 * int(cell.partition("_")[0])
                least = [max(1, math.ceil(size * n / S.HELD_BYTES)) for n in (asked[cell], self._rows[cell])]
                # where cells are few, their queries are divided
                rows = max(least[0], min(asked[cell], math.ceil(4 * cores / len(asked) / least[1])))
                parts.append((cell, tasks, rows, least[1]))
                tasks += rows * least[1]
        layout = F.broadcast(self.spark.createDataFrame(parts, "cell string, _from int, _rows int, _columns int"))
        here, there = F.pmod(F.xxhash64(query_id, "vector"), "_rows"), F.pmod(F.xxhash64(*keys, "vector"), "_columns")
        one = pairs.join(layout, "cell").withColumn(
            "_cell", S._cells(F.col("_columns"), lambda i: F.col("_from") + here * F.col("_columns") + i))
        other = self.chunks().where(F.col("cell").isin(list(asked))).join(layout, "cell").withColumn(
            "_cell", S._cells(F.col("_rows"), lambda i: F.col("_from") + there + i * F.col("_columns")))
        return S._matched(one, other, max(1, tasks), query_id, keys, S._matcher(k, query_id, keys, per_candidate))
