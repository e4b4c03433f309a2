"""An approximate vector index: coarse cells by k-means, vectors stored by cell, a few cells probed for each query, exact ranking of what they hold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provisio.operators.retrieval import QUERY_BLOCK
from provisio.sources.store import Versions

#: Vectors that centres are fitted on, at most; every vector is indexed. Cells of an index.
SAMPLE, CELLS = 100_000, 64
#: How many cells a query probes is measured when an index is fitted: so many that, of TRIED vectors at most, TRIES queries find this share of their NEAREST.
TRIED, TRIES, NEAREST, SHARE = 10_000, 200, 10, 0.95


def unit(column: str = "embedding"):
    """A vector of length one; of a zero vector, itself."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(column, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def probes_for(points: np.ndarray, centres: np.ndarray) -> int:
    """The least number of probes that finds SHARE of the nearest of some of the points among all of them."""
    half = (centres * centres).sum(1) / 2
    cell = np.argmin(half - points @ centres.T, axis=1)
    q = points[:: max(1, len(points) // TRIES)]
    nearest = np.argsort(-(q @ points.T), axis=1, kind="stable")[:, :NEAREST]
    order = np.argsort(half - q @ centres.T, axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell among those of a query
    at = np.take_along_axis(place, cell[nearest], axis=1)
    return int(np.quantile(at, SHARE, method="higher")) + 1


class VectorIndex(Versions):
    """Vectors (id, embedding) in folders by cell; the manifest holds the centres, CELLS rows at most.

    Fitted on at most SAMPLE vectors, drawn by hash of the id (and probes on TRIED of them, which the driver holds); vectors that are added later go to the nearest of the same centres, as a further folder of the version.
    """

    START = {"version": 0, "batches": {}, "centres": [], "probes": 1, "folders": []}

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)

    def _near(self, vectors: DataFrame, centres: list[list[float]], n: int) -> DataFrame:
        """vectors with cells: the n nearest centres, nearest first."""
        at = np.array(centres)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
        names = vectors.columns
        where = names.index("embedding")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (at * at).sum(1) / 2
            for batch in batches:
                if batch.num_rows:
                    v = np.asarray(batch.column(where).flatten(), np.float64).reshape(batch.num_rows, -1)
                    cells = np.argsort(half - v @ at.T, axis=1, kind="stable")[:, :n].astype(np.int32)
                    offsets = np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()))], names=[*names, "cells"])

        return vectors.mapInArrow(run, f"{kinds}, cells array<int>")

    def add(self, vectors: DataFrame, cells: int = CELLS, batch: tuple[str, int] | None = None) -> int:
        """vectors (id, embedding; null vectors are left out) into their cells; the first time centres are fitted before."""
        base = self.manifest()
        if self.seen(batch):
            return base["version"]
        rows = vectors.where("embedding IS NOT NULL").select("id", unit().alias("embedding"))
        centres, probes = base["centres"], base["probes"]
        if not centres:
            n = rows.count()
            some = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE)
            points = some.select(array_to_vector("embedding").alias("features"))
            centres = [c.tolist() for c in KMeans(k=max(1, min(cells, n)), seed=7, maxIter=10, initSteps=2).fit(points).clusterCenters()] if n else []
            if n:
                tried = some.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(min(n, SAMPLE))) < TRIED).select("embedding").limit(2 * TRIED).collect()
                probes = probes_for(np.array([r[0] for r in tried]), np.array(centres)) if tried else len(centres)
        folder = f"c{base['version'] + 1}-{uuid.uuid4().hex[:8]}"
        if centres:
            own = self._near(rows, centres, 1).select("id", "embedding", F.get("cells", F.lit(0)).alias("cell"))
            own.hint("rebalance", "cell").sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{self.root}/{folder}")
        self.publish({**base, "version": base["version"] + 1, "centres": centres, "probes": probes, "folders": [*base["folders"], *([folder] if centres else [])], "batches": {**base["batches"], **({batch[0]: batch[1]} if batch else {})}})
        return base["version"] + 1

    def top(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """question_id, id, rank (0-based), score (cosine): for each query (question_id long, embedding) the k nearest of the vectors in its probes nearest cells (by default as many
        as were measured when the index was fitted); with probes of all cells, exact.

        Only folders of probed cells are read. Queries go QUERY_BLOCK at a time; a task multiplies the vectors of a cell with the queries that probe it, and keeps k for each.
        """
        at, out = self.manifest(), None
        schema = "question_id long, id string, score double"
        asked = queries.select(F.col("question_id").cast("long").alias("question_id"), unit().alias("embedding"))
        blocks = -(-asked.count() // QUERY_BLOCK) if at["folders"] else 0
        near = self._near(asked, at["centres"], probes or at["probes"]) if blocks else None
        for b in range(blocks):
            rows = near.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK
            if not rows:
                continue
            probing: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                for c in r["cells"]:
                    probing.setdefault(c, []).append(i)
            shared = self.spark.sparkContext.broadcast((np.array([r["question_id"] for r in rows]), np.array([r["embedding"] for r in rows]), {c: np.array(i) for c, i in probing.items()}))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, q, probing = shared.value
                for batch in batches:
                    cell = np.asarray(batch.column(2))
                    v = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else None
                    for c in np.unique(cell).tolist():
                        own, mine = np.flatnonzero(cell == c), probing.get(c)
                        if mine is None:
                            continue
                        score = q[mine] @ v[own].T
                        n = min(k, len(own))
                        best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                        who = np.repeat(np.arange(len(mine)), n)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[mine[who]]), batch.column(0).take(pa.array(own[best.ravel()])), pa.array(score[who, best.ravel()])], names=["question_id", "id", "score"])

            for folder in at["folders"]:
                held = self.spark.read.schema("id string, embedding array<double>, cell int").parquet(f"{self.root}/{folder}").where(F.col("cell").isin(*probing))
                part = held.select("id", "embedding", "cell").mapInArrow(run, schema)
                out = part if out is None else out.union(part)
        if out is None:
            return self.spark.createDataFrame([], "question_id long, id string, rank int, score double")
        rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "id")) - 1
        return out.withColumn("rank", rank).where(F.col("rank") < k).select("question_id", "id", "rank", "score")


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: queries, and recall, the share of the exact k nearest (question_id, id) that were found."""
    both = exact.join(found.select("question_id", "id", F.lit(1).alias("_hit")), ["question_id", "id"], "left")
    return both.agg(F.count_distinct("question_id").alias("queries"), (F.count("_hit") / F.count("*")).alias("recall"))
