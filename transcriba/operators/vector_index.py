"""A vector index on files: vectors in buckets around centroids, exact search that skips buckets, changes that touch few of them.

folder/centroids holds the centroids; folder/vectors/bucket=b the vectors of a bucket with their distance to its
centroid; folder/radii/bucket=b the greatest of these distances and their number. The ids are saved beside
the vectors, so what is read back needs no other table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from .search import ASKED_VALUES, CELL_VALUES, cell_top

#: Buckets at most, and vectors that place their centroids for each of them, taken by a hash of the id.
BUCKETS, SAMPLE = 1024, 32
#: What a bound may be short of by rounding.
SLACK = 1e-5


def _centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means on a bounded sample; a centroid that wins nothing stays where it is."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ c.T - (c**2).sum(1) / 2).argmax(1)
        for j in np.unique(near):
            c[j] = sample[near == j].mean(0)
    return c


class VectorIndex:
    """Create or open, search, update."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        rows = spark.read.parquet(f"{folder}/centroids").orderBy("bucket").collect()  # BUCKETS rows at most
        self.centroids = np.array([r.centroid for r in rows], np.float64)

    @classmethod
    def create(cls, vectors: DataFrame, folder: str, buckets: int | None = None) -> VectorIndex:
        """Index of vectors (chunk_id, embedding); about the square root of their number in buckets, BUCKETS at most, if not said."""
        spark, n = vectors.sparkSession, vectors.count()
        k = max(1, min(BUCKETS, buckets or int(n**0.5), max(n, 1)))
        sample = vectors.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(k * SAMPLE).collect()
        x = np.array([r.embedding for r in sample], np.float64) if sample else np.zeros((1, 1))
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(_centroids(x, k))]
        spark.createDataFrame(rows, "bucket int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
        kinds = [tuple(vectors.schema[c].dataType.simpleString() for c in ("chunk_id", "embedding"))]
        spark.createDataFrame(kinds, "id string, embedding string").coalesce(1).write.parquet(f"{folder}/kinds")
        index = cls(spark, folder)
        index._write(index._placed(vectors))
        return index

    def _placed(self, vectors: DataFrame) -> DataFrame:
        c, id_type = self.centroids, vectors.schema["chunk_id"].dataType.simpleString()

        def place(batches):
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                near = (x @ c.T - (c**2).sum(1) / 2).argmax(1) if len(x) else np.zeros(0, np.int64)
                far = np.linalg.norm(x - c[near], axis=1) if len(x) else np.zeros(0)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(far), pa.array(near.astype(np.int32))], ["chunk_id", "embedding", "far", "bucket"])

        kind = vectors.schema["embedding"].dataType.simpleString()
        return vectors.select("chunk_id", "embedding").mapInArrow(place, f"chunk_id {id_type}, embedding {kind}, far double, bucket int")

    def _write(self, placed: DataFrame) -> None:
        """Writes whole buckets; those that placed does not have stay as they are."""
        for part, rows in (("vectors", placed), ("radii", placed.groupBy("bucket").agg(F.max("far").alias("radius"), F.count("*").alias("n")))):
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{part}")

    def vectors(self) -> DataFrame:
        """chunk_id, embedding, far, bucket of all vectors."""
        id_type, kind = self._kinds()
        return self.spark.read.schema(f"chunk_id {id_type}, embedding {kind}, far double, bucket int").parquet(f"{self.folder}/vectors")

    def _kinds(self) -> tuple[str, str]:
        r = self.spark.read.parquet(f"{self.folder}/kinds").first()
        return r.id, r.embedding

    def _bounds(self, queries: DataFrame) -> DataFrame:
        """query_id, q, bucket, n, bound: no vector of the bucket has a larger inner product with the query than bound."""
        radii = self.spark.read.schema("radius double, n long, bucket int").parquet(f"{self.folder}/radii").join(self.spark.read.parquet(f"{self.folder}/centroids"), "bucket")
        norm = F.sqrt(N.dot(F.col("q"), F.col("q")))
        pairs = queries.select("query_id", "q").join(F.broadcast(radii), F.lit(True))  # BUCKETS rows at most
        return pairs.select("query_id", "q", "bucket", "n", (N.dot(F.col("q"), F.col("centroid")) + norm * F.col("radius") + SLACK).alias("bound"))

    def _best(self, pairs: DataFrame, k: int) -> DataFrame:
        """The k best of each query in its buckets. A bucket of many vectors is dealt into parts, many queries into blocks."""
        sizes = self.spark.read.schema("radius double, n long, bucket int").parquet(f"{self.folder}/radii").select("bucket", (F.col("n") * self.centroids.shape[1] / CELL_VALUES).cast("int").alias("more"))
        blocks = max(1, -(-pairs.select("query_id").distinct().count() * self.centroids.shape[1] // ASKED_VALUES))
        each = lambda n: F.explode(F.sequence(F.lit(0), n))
        held = self.vectors().join(F.broadcast(sizes), "bucket")  # BUCKETS rows at most
        held = held.select("bucket", "chunk_id", "embedding", F.pmod(F.xxhash64("chunk_id"), F.col("more") + 1).cast("int").alias("part"), each(F.lit(blocks - 1)).alias("block"))
        asked = pairs.select("bucket", "query_id", "q").join(F.broadcast(sizes), "bucket")
        asked = asked.select("bucket", "query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), each(F.col("more")).alias("part"))
        rows = cell_top(asked, held, ["bucket", "block", "part"], k)
        w = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "chunk_id")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def plan(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, q, bucket, first: the buckets that may hold one of the k best of a query, those read first by their bounds marked.

        The first buckets are as many as hold k vectors; the k-th best among them is a floor, and a bucket whose bound lies below is never read.
        """
        bounds = self._bounds(queries)
        before = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1))
        bounds = bounds.withColumn("first", F.coalesce(before, F.lit(0)) < k)
        floor = self._best(bounds.where("first"), k).where(F.col("rank") == k).select("query_id", F.col("semantic").alias("floor"))
        rows = bounds.join(floor, "query_id", "left")
        return rows.where(F.col("first") | F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).select("query_id", "q", "bucket", "first")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id, semantic, rank: exactly the k largest inner products of each query (query_id, q), ties by id."""
        return self._best(self.plan(queries, k), k)

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Removes vectors (chunk_id), adds others (chunk_id, embedding), an added one in place of its old one; the number of buckets rewritten.

        Ids that are not there are removed without effect; of rows that repeat an added id one counts. Only ids are read to find the buckets that change; these alone are
        read whole and written, first beside the index and then in their place.
        """
        spark, held = self.spark, self.vectors()
        new = None if added is None else self._placed(added.dropDuplicates(["chunk_id"]))
        gone = [x.select("chunk_id") for x in (added, removed) if x is not None]
        if not gone:
            return 0
        gone = gone[0] if len(gone) == 1 else gone[0].union(gone[1])
        touched = held.join(gone, "chunk_id", "left_semi").select("bucket")
        touched = sorted(r.bucket for r in (touched if new is None else touched.union(new.select("bucket"))).distinct().collect())  # BUCKETS rows at most
        kept = held.where(F.col("bucket").isin(touched)).select("chunk_id", "embedding", "far", "bucket").join(gone, "chunk_id", "left_anti")
        rows = kept if new is None else kept.unionByName(new)
        beside = f"{self.folder}/_change"
        rows.write.mode("overwrite").parquet(beside)
        rows = spark.read.schema(rows.schema).parquet(beside)
        full = {r.bucket for r in rows.select("bucket").distinct().collect()}
        self._write(rows)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for b in set(touched) - full:  # a bucket that lost its last vector
            for part in ("vectors", "radii"):
                fs.delete(hadoop(f"{self.folder}/{part}/bucket={b}"), True)
        fs.delete(hadoop(beside), True)
        return len(touched)
