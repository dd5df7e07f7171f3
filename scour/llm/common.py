"""Small helpers shared by the operators: free column names, stable hashes, caches, connected components."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scour.session import cut_lineage

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text), a null text read as empty; other columns are left behind."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def if_small(ids: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marked for broadcast if a count shows at most ``rows`` rows of a few numbers each (some 30 MB); else joined by shuffle.

    ``ids`` should be a written table, which is cheap to count.
    """
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def worker_cache(key: object, build: Callable[[], object]) -> object:
    """An object that a Python worker keeps between tasks. Functions travel by value, so their module's globals do not last."""
    home = sys.modules.setdefault("scour_worker_cache", types.ModuleType("scour_worker_cache"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def forget() -> None:
    """Give back what is left of earlier tasks in this Python worker, which later stages use again: objects kept and free memory."""
    home = sys.modules.get("scour_worker_cache")
    if home:
        home.__dict__.get("kept", {}).clear()
    give_back()


def give_back() -> None:
    """Return this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # other C libraries do without
    if trim:
        trim(ctypes.c_size_t(0))


def leaves_little(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``run`` over a group's table or two, after which the worker gives its free memory back. Tasks take turns
    on all workers that a stage with several Python steps began, so what each keeps adds up."""

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        forget()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        forget()
        return out

    return one if run.__code__.co_argcount == 1 else two


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words by their bytes; a table of known words takes longer than hashing, and memory in every worker."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(31))) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[2]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence where it is shorter. In order, with repeats."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * MIX[0] + hashes[i : n - width + 1 + i])
    return out


class Forest:
    """Union-find over integer nodes; roots are the smallest nodes."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.parent if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by stars with the same components; at most 200,000 nodes are held at once."""
    forest = Forest()

    def flush() -> pa.RecordBatch:
        a, b = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.parent) > 200_000:
            yield flush()
            forest = Forest()
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges`` (a, b); nodes without edges are absent.

    Alternates large-star and small-star steps, each a grouped minimum and an equi-join, until the edges
    no longer change. Every round is written to the shared folder, so lost executors cost one round at most.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.mapInArrow(_contracted, "a long, b long").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut_lineage(small.select("e.a", "e.b").where("a <> b").mapInArrow(_contracted, "a long, b long").distinct())
