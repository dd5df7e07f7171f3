"""Size-aware heavy-light join of documents whose word shingles have a high Jaccard similarity.

Two sets of sizes a and b link when they share at least ``overlap(a, b)`` shingles.

*Small sets* enumerate all their subsets of that fixed size, one group of subsets for each partner size.
Equal subsets prove a link, so nothing is left to verify.

*Large sets* are counted against inverted lists. A set of a size class is dealt by hash into ``SPARE`` parts more
than two linked sets of the class can differ in, so linked sets agree on so many parts or more. A list holds the sets
that agree on one part; scanning the lists counts on how many parts sets agree with one set of each list, and those that
agree on ``KEEP`` or more are verified on their shingles. Two sets differ by less than the widest pair of the class, so most must
agree on more parts; a set that stands in fewer shared lists than its size requires is dropped. What links is a cluster. Sets of different clusters that share
a list are listed again, under their rarest shingles, and those that meet there are verified.

The *boundary* is the largest size up to which enumerating is the cheaper of the two, by the number of rows a
set emits, a list row counting ``LIST_COST`` times since it must be verified.

Copies meet as one representative, and members of a group are tied to its smallest; pairs are made only between
clusters that share a list.

Defined results: texts that are null, empty or without words have no shingles and link with nothing; texts
with fewer words than a shingle have one shingle, all their words. Rows that share an id are one document for
linking. Rows with a null id are alone, their component is null. Extra columns are ignored. Sets are compared
by 64-bit hashes of their shingles, copies by size and two sums of such hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scour.llm.common import components, encoded, forget, if_small, leaves_little, mixed, shingle_hashes, texts_of, word_hashes
from scour.session import copied, cut_lineage, discard

LIST_COST = 4
# Linked sets agree on this many parts; at most SPARE - KEEP of them are empty and not listed.
SPARE = 9
KEEP = 5
PRUNINGS = 2
ROUNDS = 2
PARTNERS = 100


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words; sets link when den * intersection >= num * union."""

    words: int
    num: int
    den: int
    bounds: list[int] = field(default_factory=lambda: [1], compare=False)

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def largest(self, size: int) -> int:
        """The largest partner of a set."""
        return size * self.den // self.num

    def smallest(self, size: int) -> int:
        return -(-size * self.num // self.den)

    def size_class(self, size: int) -> int:
        """Classes are runs of sizes that may all link with the first of the run."""
        while self.bounds[-1] <= size:
            self.bounds.append(self.largest(self.bounds[-1]) + 1)
        return bisect_right(self.bounds, size) - 1

    def parts(self, klass: int) -> int:
        """How many parts the sets of a class and their smaller partners are dealt into."""
        most = self.bounds[klass + 1] - 1
        return 2 * most * (self.den - self.num) // (self.den + self.num) + SPARE

    def instances(self, size: int) -> list[int]:
        """The classes in which a set may be the larger or the smaller of two."""
        own = self.size_class(size)
        return [own, own + 1] if self.size_class(self.largest(size)) > own else [own]

    def needed(self, size: int) -> list[int]:
        """On how many listed parts a set agrees with each set it links with, in its even and in its odd class."""
        out = [KEEP, KEEP]
        for klass in self.instances(size) if size else []:
            most = min(self.largest(size), self.bounds[klass + 1] - 1)
            out[klass % 2] = self.parts(klass) - (size + most) * (self.den - self.num) // (self.den + self.num) - (SPARE - KEEP)
        return out

    def subset_sizes(self, size: int, boundary: int) -> list[tuple[int, int]]:
        """(partner size, shared size) for partners up to the boundary; equal sets have met already."""
        pairs = ((b, self.overlap(size, b)) for b in range(self.smallest(size), min(self.largest(size), boundary) + 1))
        return [(b, o) for b, o in pairs if o <= min(size, b) and not (b == size == o)]

    @property
    def boundary(self) -> int:
        size = 0
        while True:
            nxt = size + 1
            lists = LIST_COST * sum(self.parts(k) for k in self.instances(nxt))
            if sum(comb(nxt, o) for _, o in self.subset_sizes(nxt, self.largest(nxt))) > lists:
                return size
            size = nxt


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; only A-Z are lower-cased and only ASCII white space parts words."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split()), words))


def list_keys(shingles: np.ndarray, like: Likeness, boundary: int) -> np.ndarray:
    """Hashes of the parts of a large set, or of a small one that may have a large partner. The lowest bit tells even classes from odd ones."""
    size = len(shingles)
    if like.largest(size) <= boundary:
        return np.empty(0, np.int64)
    out = []
    for klass in like.instances(size):
        parts = like.parts(klass)
        part = (mixed(shingles, 2 * klass + 1) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        present, starts = np.unique(part[order], return_index=True)
        sums = np.zeros(parts, np.uint64)
        sums[present] = np.add.reduceat(mixed(shingles, 7)[order], starts)
        # SPARE parts agree at least. Without the empty ones, if these are few, KEEP that have shingles do.
        named = np.arange(parts) if parts - len(present) > SPARE - KEEP else present
        keys = mixed(sums[named] + mixed((np.uint64(klass) << np.uint64(32)) + named.astype(np.uint64), 11), 13)
        out.append(keys & ~np.uint64(1) | np.uint64(klass % 2))
    return np.concatenate(out).view(np.int64)


def subset_keys(shingles: np.ndarray, like: Likeness, boundary: int) -> np.ndarray:
    """Hashes of all subsets of a small set that prove a link with a small partner.

    The low two bits tell whether the set is the smaller (0) or the larger (1) of the two, or of the same size (2):
    two of the larger sets that share the subset need not link.
    """
    size = len(shingles)
    if not 0 < size <= boundary:
        return np.empty(0, np.int64)
    out = []
    values = mixed(shingles, 17)
    for other, shared in like.subset_sizes(size, boundary):
        gone = size - shared
        drop = np.fromiter((i for c in combinations(range(size), gone) for i in c), np.int64).reshape(comb(size, gone), gone)
        sums = values.sum() - values[drop].sum(axis=1, dtype=np.uint64)
        salt = np.uint64(min(size, other) << 32 | max(size, other))
        role = 2 if size == other else int(size > other)
        out.append(mixed(sums + mixed(np.full(1, salt), 19), 23) & ~np.uint64(3) | np.uint64(role))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def _ragged(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)))


def signed_sets(docs: DataFrame, like: Likeness) -> DataFrame:
    """Size, identity and keys of every document's set."""
    boundary = like.boundary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                sets = [shingle_set(t, like.words) for t in encoded(part.column(1))]
                needs = [like.needed(len(s)) for s in sets]
                with np.errstate(over="ignore"):
                    arrays = [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(mixed(s, 3).sum().view(np.int64)) for s in sets], pa.int64()),
                        pa.array([int(mixed(s, 5).sum().view(np.int64)) for s in sets], pa.int64()),
                        _ragged([list_keys(s, like, boundary) for s in sets]), _ragged([subset_keys(s, like, boundary) for s in sets]),
                        *(pa.array([x[side] for x in needs], pa.int64()) for side in range(2)),
                    ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "s1", "s2", "list_keys", "subset_keys", "even", "odd"])
        forget()

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, list_keys array<long>, subset_keys array<long>, even long, odd long")


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of runs of equal keys with two nodes or more; rows come sorted by (key, node).

    A run may go on in the next partition or batch, so the first and the last run of a batch are always returned.
    """
    for batch in batches:
        key, node = (batch.column(i).to_numpy() for i in range(2))
        if len(key):
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(starts[1:], len(key)) - 1
            kept = node[starts] != node[ends]
            kept[[0, -1]] = True
            rows = np.repeat(kept, ends - starts + 1)
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(node[rows])], ["key", "node"])


def listed(sets: DataFrame, needs: DataFrame) -> DataFrame:
    """(key, node, cluster): the inverted lists with two documents or more, of documents that stand in enough of them; clusters are single yet.

    Ranges of (key, node) split hot keys, and only keys that two documents have go further.
    """
    rows = sets.where("doc_id IS NOT NULL").select(F.explode("list_keys").alias("key"), F.col("doc_id").alias("node"))
    rows = cut_lineage(rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long"))
    return pruned(rows.withColumn("cluster", F.col("node")), needs, PRUNINGS)


def pruned(rows: DataFrame, needs: DataFrame, rounds: int = 1) -> DataFrame:
    """(key, node, cluster): the lists that hold two clusters or more, of documents that stand in as many as a link needs in one size class.

    Linked sets of different clusters do, in the class of the larger one, so dropping the others, again as that takes others with it, loses no link.
    """
    side = F.col("key").bitwiseAND(1).alias("side")
    for _ in range(rounds):
        several = rows.groupBy("key").agg(F.min("cluster").alias("m"), F.max("cluster").alias("x")).where("m < x").select("key")
        rows = rows.join(several, "key").select("*", side)
        strong = rows.groupBy("node", "side").agg(F.count("*").alias("keys")).join(needs, ["node", "side"]).where("keys >= need").select("node", "side")
        rows = cut_lineage(rows.join(if_small(cut_lineage(strong)), ["node", "side"]).select("key", "node", "cluster"))
    return rows


def list_links(docs: DataFrame, placed: DataFrame, needs: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): links, enough to connect what is connected.

    Families of copies are tied first, in rounds of at most one pair a document. Each list chooses one cluster by a hash of its own in
    each round, and the least member there speaks for it; a document of another cluster is verified against the one with which it shares
    most lists, ``KEEP`` or more. Documents of lists that hold two clusters or more then meet by their rarest shingles, all of them.
    """
    rows, links = placed.drop("cluster"), None
    for salt in range(ROUNDS):
        choice = F.struct((F.xxhash64("cluster", F.lit(salt)) if salt else F.col("cluster")).alias("rank"), "cluster", "node")
        heads = placed.groupBy("key").agg(F.min(choice).alias("head")).select("key", F.col("head.cluster").alias("other"), F.col("head.node").alias("b"))
        near = placed.join(heads, "key").where("cluster <> other").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("n")).where(F.col("n") >= KEEP)
        best = near.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
        found = cut_lineage(verified(docs, best, like))
        links = found if links is None else links.unionByName(found)
        placed = pruned(rows.join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("cluster")), needs)
        if not found.limit(1).count():
            break
    members = cut_lineage(placed.select("node", "cluster").distinct())
    # Written, since a stage that verifies and ties at once begins two Python workers a core, which stay.
    return links.unionByName(cut_lineage(verified(docs, rare_pairs(docs, members, like), like)))


def rare_pairs(docs: DataFrame, members: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): every pair of linked members of different clusters, and few others.

    Shingles are ranked, those that lie in one cluster first, the others by the number of sets that hold them. Sets that share enough of their
    shingles share one of their first few: of the smaller set those that an equal partner may lack and one more, of the larger those that its
    smallest partner may lack and one more; of both no more than the two sizes allow. So relatives that differ too much do not meet: what each has of its own takes up its first places.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                sets = [shingle_set(t, like.words) for t in encoded(part.column(3))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(x) for x in sets], pa.int64()), _ragged([x.view(np.int64) for x in sets])], names)

    names = ["node", "cluster", "set", "n", "g"]
    texts = docs.join(if_small(members.withColumnRenamed("node", "doc_id")), "doc_id").select(F.col("doc_id").alias("node"), "cluster", F.xxhash64("text").alias("set"), "text")
    sets = texts.mapInArrow(run, "node long, cluster long, set long, n long, g array<long>").select(*names[:4], F.explode("g").alias("g"))
    sets = cut_lineage(sets)
    shared = sets.groupBy("g").agg(F.count("*").alias("held"), F.min("cluster").alias("m"), F.max("cluster").alias("x")).where("m < x").select("g", "held")
    sets = sets.join(shared, "g")
    size = lambda c: F.ceil(like.num * c / (like.num + like.den)).cast("long")
    smallest = F.expr(f"(n * {like.num} + {like.den - 1}) div {like.den}")
    own = F.col("n") - F.count("*").over(Window.partitionBy("node", "set"))
    rank = F.row_number().over(Window.partitionBy("node", "set").orderBy("held", "g")) + own
    first = sets.withColumn("rank", rank).withColumn("short", F.col("rank") <= F.col("n") - size(2 * F.col("n")) + 1)
    first = cut_lineage(first.where(F.col("rank") <= F.col("n") - size(F.col("n") + smallest) + 1).select("g", "node", "cluster", "n", "rank", "short"))
    larger = first.select("g", F.col("node").alias("b"), F.col("cluster").alias("other"), F.col("n").alias("m"), F.col("rank").alias("place"))
    alike = (F.col("cluster") != F.col("other")) & (F.col("n") <= F.col("m")) & (F.col("m") * like.num <= F.col("n") * like.den)
    needed = size(F.col("n") + F.col("m"))
    early = (F.col("rank") <= F.col("n") - needed + 1) & (F.col("place") <= F.col("m") - needed + 1)
    return first.where("short").join(larger, (first["g"] == larger["g"]) & alike & early).select(F.col("node").alias("a"), "b").distinct()


def verified(docs: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose shingle sets link. Texts of ``a`` come to the text of ``b``, whose many partners are spread over salts."""
    pairs = cut_lineage(pairs)
    heads = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("salts"))
    pairs = cut_lineage(pairs.join(heads, "b"))
    homes = pairs.count() // PARTNERS + 1
    home = F.pmod(F.xxhash64("b", "salt"), F.lit(homes))
    left = docs.join(if_small(pairs.withColumnRenamed("a", "doc_id")), "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    right = docs.join(if_small(pairs.select(F.col("b").alias("doc_id"), "salts").distinct()), "doc_id")
    right = right.select(F.col("doc_id").alias("b"), F.col("text").alias("centre"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))

    def link(members: pa.Table, centres: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for b, text in zip(centres.column("b").to_pylist(), centres.column("centre").to_pylist(), strict=True):
            sets.setdefault(b, []).append(shingle_set(text.encode(), like.words))
        out: tuple[list[int], list[int]] = ([], [])
        for a, b, text in zip(*(members.column(c).to_pylist() for c in ("a", "b", "member")), strict=True):
            mine = shingle_set(text.encode(), like.words)
            for other in sets.get(b, ()):
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                if len(mine) and shared * (like.num + like.den) >= like.num * (len(mine) + len(other)):
                    out[0].append(a)
                    out[1].append(b)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    left = left.select(home.alias("home"), F.col("doc_id").alias("a"), "b", F.col("text").alias("member"))
    right = right.select(home.alias("home"), "b", "centre")
    return left.groupBy("home").cogroup(right.groupBy("home")).applyInArrow(leaves_little(link), "a long, b long")


def subset_edges(sets: DataFrame) -> DataFrame:
    """(a, b): links of small sets that share a subset. Every smaller set links with every larger one, so the least of each side ties the other."""
    rows = sets.where("doc_id IS NOT NULL").select(F.explode("subset_keys").alias("key"), F.col("doc_id").alias("a"))
    rows = rows.select(F.shiftright("key", 2).alias("key"), F.col("key").bitwiseAND(3).alias("role"), "a")
    least = rows.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("a"))).alias(f"m{r}") for r in range(3)], F.count("*").alias("rows")).where("rows > 1")
    other = F.when(F.col("role") == 0, F.col("m1")).when(F.col("role") == 1, F.col("m0")).otherwise(F.col("m2"))
    return rows.join(least, "key").select("a", other.alias("b")).where("a <> b").distinct()


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; documents are connected by links of similarity >= num / den."""
    like = Likeness(words, num, den)
    docs = texts_of(docs, doc_id, text)
    keyed, keys = copied(signed_sets(docs, like))
    sets = cut_lineage(keyed.drop("list_keys", "subset_keys"))
    # Rows that share an id need what the least of them does.
    needs = sets.groupBy(F.col("doc_id").alias("node")).agg(F.min("even").alias("even"), F.min("odd").alias("odd"))
    needs = cut_lineage(needs.selectExpr("node", "stack(2, 0L, even, 1L, odd) AS (side, need)"))
    usable = sets.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "n", "s1", "s2")
    classes = usable.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    copies = cut_lineage(usable.join(classes, ["n", "s1", "s2"]).where("doc_id <> rep").select("doc_id", "n", "s1", "s2", "rep").distinct())
    # Of copies one speaks for all.
    single = keyed.join(if_small(copies.drop("rep")), ["doc_id", "n", "s1", "s2"], "left_anti")
    exact = cut_lineage(subset_edges(single))
    lists = listed(single, needs)
    discard(docs.sparkSession, keys)  # the largest table; all that is needed of it has been written
    links = list_links(docs, lists, needs, like)
    joined = components(links.unionByName(exact).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"))
        .join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def first_of_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents whose id is the smallest of their component; rows with a null id stay."""
    later = cut_lineage(jaccard_components(docs, words, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("_later")).distinct())
    return docs.join(if_small(later), F.col("doc_id").cast("long") == F.col("_later"), "left_anti")
