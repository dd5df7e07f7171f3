"""Nearest neighbours by inner product with multi-index hashing.

*Codes.* Vectors are lifted by one coordinate so that all have the same length, which makes the largest inner
product the smallest angle. From a bounded sample (``sample_rows`` vectors, those with the smallest hashes) several rotations are
learned by alternating between signs and the best rotation onto them; the signs of the rotated vector are
its code of ``bits`` bits.

*Index.* Codes are split into substrings of eight bits, and each substring has a table from value to rows. If
two codes differ in at most r bits, some substring differs in at most r / substrings of them, so looking up all
values within that distance in every table finds every code within r. The radius grows table by
table until ``candidates`` codes lie within it; those are ranked by the double-precision inner product of the original vectors.

*Spreading.* All rows are indexed, in tiles of ``tile_bytes`` of vectors, each searched in a task of its own for a tile
of ``query_rows`` queries; the best of each tile meet at the query, cut to the wanted number before the shuffle. Equal vectors are
indexed once, with their smallest ids, as many as can be wanted, so a vector that a third of all rows share is one row.

Defined results: vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor do
vectors whose length is not the most common one (of equals the largest), nor rows with a null id. Of rows that
share an id and a vector one counts. Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scour.session import cut_lineage

CHUNK = 8
DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass(frozen=True)
class Codes:
    """Learned rotations, the centre that is taken off first, and the longest vector's length."""

    centre: np.ndarray
    rotations: np.ndarray
    longest: float

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        norms = np.linalg.norm(x, axis=1)
        if query:
            return np.c_[x / norms[:, None], np.zeros(len(x))]
        return np.c_[x / self.longest, np.sqrt(np.maximum(0, 1 - (norms / self.longest) ** 2))]

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        turned = (self.lifted(x, query) - self.centre) @ self.rotations
        pad = -turned.shape[1] % CHUNK
        return np.packbits(np.pad(turned > 0, ((0, 0), (0, pad))), axis=1)


def learn(x: np.ndarray, longest: float, bits: int, rounds: int = 20, seed: int = 0) -> Codes:
    """Rotations that bring the centred sample close to the corners of a cube, one block of dimensions after another."""
    rng = np.random.default_rng(seed)
    blank = Codes(np.zeros(x.shape[1] + 1), np.eye(x.shape[1] + 1), longest)
    data = blank.lifted(x, False)
    centre = data.mean(axis=0)
    data = data - centre
    dims = data.shape[1]
    out = []
    while sum(r.shape[1] for r in out) < bits:
        turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(data @ turn > 0, 1.0, -1.0).T @ data, full_matrices=False)
            turn = (u @ v).T
        out.append(turn)
    return Codes(centre, np.hstack(out)[:, :bits], longest)


class Tables:
    """For each substring of the codes, the rows by value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.columns = np.ascontiguousarray(codes.T)
        self.words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)
        self.order = np.argsort(self.columns, axis=1, kind="stable")
        self.starts = np.array([np.searchsorted(c[o], np.arange(257)) for c, o in zip(self.columns, self.order, strict=True)])

    def ring(self, code: np.ndarray, reach: int) -> np.ndarray:
        """Which rows have some substring exactly ``reach`` bits from the query's: few values are looked up, many are marked in one pass."""
        found = np.zeros(len(self.codes), bool)
        for j, value in enumerate(code.tolist()):
            near = DISTANCE[value] == reach
            if reach < 2:
                for v in np.flatnonzero(near).tolist():
                    found[self.order[j, self.starts[j, v] : self.starts[j, v + 1]]] = True
            else:
                found |= near[self.columns[j]]
        return found

    def nearest_codes(self, code: np.ndarray, wanted: int) -> np.ndarray:
        """All rows within the smallest radius that holds ``wanted`` of them, or all rows."""
        parts, wanted = self.codes.shape[1], min(wanted, len(self.codes))
        word = np.pad(code, (0, -parts % 8)).view(np.uint64)
        distance = np.full(len(self.codes), 8 * parts + 1, np.int16)
        for reach in range(CHUNK + 1):
            rows = np.flatnonzero(self.ring(code, reach) & (distance > 8 * parts))
            distance[rows] = np.bitwise_count(self.words[rows] ^ word).sum(axis=1)
            # Everything up to this radius has been found, by the pigeonhole principle.
            if (distance < parts * (reach + 1)).sum() >= wanted:
                return np.flatnonzero(distance <= np.partition(distance, wanted - 1)[wanted - 1])
        return np.arange(len(self.codes))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): rows that take part, as double arrays."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND size(x) > 0")
    fine = rows.where("forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(x, v -> v <> 0)")
    fine = fine.withColumn("x", F.expr("transform(x, v -> v + 0.0D)"))  # minus zero is zero
    size = fine.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).select("size").first()
    return fine.where(F.size("x") == (size[0] if size else 0)).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, bits: int = 256, candidates: int = 1000, sample_rows: int = 4096,
    tile_bytes: int = 32_000_000, query_rows: int = 2048, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows of ``vectors`` with other ids."""
    rows = cut_lineage(usable(vectors, vec_id, embedding))
    asked = usable(queries, vec_id, embedding).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    # Of equal vectors as many ids as one query may want, and one more: its own.
    ranked = rows.withColumn("copy", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("copy") <= k + 1)
    index = cut_lineage(ranked.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    head = index.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).alias("longest")).first()
    out = "query_id long, vec_id long, score double"
    if not head.n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r.x for r in index.orderBy(F.xxhash64("x"), "x").limit(sample_rows).select("x").collect()])
    codes = learn(sample, head.longest, bits)
    tiles = int(head.n * sample.shape[1] * 8 // tile_bytes) + 1
    query_tiles = int(asked.count() // query_rows) + 1

    def encoded(query: bool, name: str):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = codes.of(_matrix(batch.column(name)), query) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in found], pa.binary())], [*batch.schema.names, "code"])

        return run

    indexed = index.mapInArrow(encoded(False, "x"), "x array<double>, ids array<long>, code binary")
    indexed = indexed.withColumn("tile", F.pmod(F.xxhash64("x"), F.lit(tiles)).cast("int")).withColumn("query_tile", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))
    coded = asked.mapInArrow(encoded(True, "q"), "query_id long, q array<double>, code binary")
    coded = coded.withColumn("query_tile", F.pmod(F.xxhash64("query_id"), F.lit(query_tiles)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def search(data: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if data.num_rows and wanted.num_rows:
            x, ids = _matrix(data.column("x")), data.column("ids").to_pylist()
            read = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            tables = Tables(read(data))
            for query, q, code in zip(wanted.column("query_id").to_pylist(), _matrix(wanted.column("q")), read(wanted), strict=True):
                near = tables.nearest_codes(code, candidates)
                scores = x[near] @ q
                best = near[scores >= np.partition(scores, max(0, len(scores) - k - 1))[max(0, len(scores) - k - 1)]]
                exact = [(float((x[i] * q).sum()), j) for i in best.tolist() for j in ids[i] if j != query]
                found += [(query, j, s) for s, j in sorted(exact, key=lambda e: (-e[0], e[1]))[:k]]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    best = indexed.groupBy("query_tile", "tile").cogroup(coded.groupBy("query_tile", "tile")).applyInArrow(search, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
