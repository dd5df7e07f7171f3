"""A Merkle manifest of a dataset: a tree of hashes over all rows, and proofs that climb it by a recursive query.

A leaf is the hash of one row: each field is ``-`` if null, else its length in UTF-8 bytes, a colon and its value.
The leaves of a source, in the order of their ids, make a tree in which every ``FAN`` consecutive nodes become one;
the roots of the sources, in the order of the sources (null first, then by bytes), make a tree above in the same way.

Building is one grouped pass a level, each over a ``FAN``-th of the rows of the last. Leaves are numbered over ranges
of (source, id), so a source with a third of all rows is spread over many tasks. The levels are stored as one table of
nodes: a node has its digest, a link to its parent, and the digests of its siblings left and right of it.

The climb is a recursive query over that table. All leaves of one run of ``FAN`` share what lies above them, so one row
climbs for a run and carries the hashes of its leaves side by side: a step joins the current node, appends its siblings to
the proof and folds each leaf's own hash with them. Nodes near the top are met by very many runs; they are stored in one
copy for each ``COPY`` runs below them, and a run goes to one of the copies by its hash, so no join key is hot. The
climb is written before it is read, so a lost executor costs the climb at most.

Defined results: a null text, source, language, count or id is the field ``-``. Rows with equal ids are ordered by their
hashes; identical rows are leaves of their own, with equal hashes. Extra columns take no part. An empty table has no
leaves and no root, and gives no rows. Texts of any length are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scour.functions.columns import col
from scour.functions.ranges import numbered
from scour.llm.common import if_small
from scour.session import cut_lineage

FAN = 16
COPY = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """The next level: every ``FAN`` consecutive nodes of a tree become one."""
    members = F.array_sort(F.collect_list(F.struct("idx", "digest")))
    runs = nodes.groupBy("tree", F.floor(F.col("idx") / FAN).alias("run")).agg(members.alias("m"), F.sum("below").alias("below"), F.max("width").alias("width"))
    digest = F.sha2(F.array_join(F.transform("m", lambda x: x["digest"]), ""), 256)
    return runs.select("tree", F.lit(level).alias("level"), F.col("run").alias("idx"), digest.alias("digest"), "below", F.ceil(F.col("width") / FAN).alias("width"))


def _levels(first: DataFrame, level: int, width: int) -> list[DataFrame]:
    """``first`` and the levels above it, each written, until the widest tree (of ``width`` nodes in ``first``) is one node."""
    out = [cut_lineage(first)]
    while width > 1:
        level, width = level + 1, -(-width // FAN)
        out.append(cut_lineage(_above(out[-1].where("width > 1"), level)))
    return out


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source", seen: Column | None = None) -> dict[str, DataFrame]:
    """The manifest of ``docs`` as written tables; the number of a source in order is its ``tree``, the tree above all is ``TOP``.

    ``runs``: tree, run, and its leaves as structs of doc_id, digest and ``seen`` (the digest of the row as it is found later, of
    the row itself by default). ``nodes``: tree, level, idx, copy, digest, ``left`` and ``right`` (siblings' digests in order), the
    parent's tree, level, idx and number of copies. ``roots``: tree, source, n_leaves, subroot, root.
    """
    spark = docs.sparkSession
    leaf = row_hash([col(f) for f in fields])
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(source).cast("string").alias("source"), leaf.alias("digest"), (leaf if seen is None else seen).alias("seen"))
    rows = numbered(rows, ["source"], ["doc_id", "digest", "seen"])
    leaves = F.array_sort(F.collect_list(F.struct("idx", "doc_id", "digest", "seen")))
    runs = cut_lineage(rows.groupBy("source", F.floor(F.col("idx") / FAN).alias("run")).agg(leaves.alias("leaves"), (F.max("idx") + 1).alias("last")))
    trees = cut_lineage(numbered(runs.groupBy("source").agg(F.max("last").alias("n"), F.count("*").alias("runs")), [], ["source"], "tree"))
    a, b = runs.alias("a"), if_small(trees).alias("b")
    runs = cut_lineage(a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("b.tree", "b.n", "a.run", "a.leaves"))

    count, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    digest = F.sha2(F.array_join(F.transform("leaves", lambda x: x["digest"]), ""), 256)
    first = runs.where("n > 1").select("tree", F.lit(1).alias("level"), F.col("run").alias("idx"), digest.alias("digest"), F.lit(1).cast("long").alias("below"), F.ceil(F.col("n") / FAN).alias("width"))
    lower = _levels(first, 1, -(-most // FAN))
    alone = runs.where("n = 1").select("tree", F.col("leaves")[0]["digest"].alias("digest"), F.lit(1).cast("long").alias("below"))
    tops = reduce(DataFrame.unionByName, [level.where("width = 1").select("tree", "digest", "below") for level in lower], alone)
    crown = tops.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "digest", "below", F.lit(count).cast("long").alias("width"))
    upper = _levels(crown, 0, count)
    nodes = _linked(reduce(DataFrame.unionByName, [*lower, *upper]))
    roots = trees.join(upper[0].select(F.col("idx").alias("tree"), F.col("digest").alias("subroot")), "tree")
    root = upper[-1].where("width = 1").select(F.col("digest").alias("root"))  # one row at most
    return {"runs": runs, "nodes": nodes, "roots": cut_lineage(roots.join(F.broadcast(root)).select("tree", "source", F.col("n").alias("n_leaves"), "subroot", "root"))}


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with their siblings and their parent, in as many copies as runs climb through them, divided by ``COPY``."""
    members = F.array_sort(F.collect_list(F.struct("idx", "digest", "below")))
    groups = nodes.groupBy("tree", "level", F.floor(F.col("idx") / FAN).alias("run")).agg(members.alias("m"), F.sum("below").alias("below"), F.max("width").alias("width"))
    groups = groups.select("*", F.transform("m", lambda x: x["digest"]).alias("digests"), F.posexplode("m").alias("place", "node"))
    top, alone = (F.col("width") == 1) & (F.col("tree") == TOP), F.col("width") == 1
    copies = lambda below: F.ceil(below / COPY).cast("int")
    joined = lambda part: F.when(alone, "").otherwise(F.array_join(part, ""))
    # The top of a source's tree goes on as a leaf of the tree above; the top of that one has no parent.
    parent = lambda inside, at_top: F.when(top, None).when(alone, at_top).otherwise(inside)
    rows = groups.select(
        "tree", "level", F.col("node.idx").alias("idx"), F.explode(F.sequence(F.lit(0), copies(F.col("node.below")) - 1)).alias("copy"), F.col("node.digest").alias("digest"),
        joined(F.slice("digests", F.lit(1), F.col("place"))).alias("left"), joined(F.slice("digests", F.col("place") + 2, F.lit(FAN))).alias("right"), (~alone).alias("folds"),
        parent(F.col("tree"), F.lit(TOP).cast("long")).alias("parent_tree"), parent(F.col("level") + 1, F.lit(0)).alias("parent_level"),
        parent(F.col("run"), F.col("tree")).alias("parent_idx"), copies(F.when(alone, F.col("node.below")).otherwise(F.col("below"))).alias("parent_copies"),
    )
    return cut_lineage(rows)


CLIMB = """WITH RECURSIVE climb(tree, run, at_tree, at_level, at_idx, at_copy, folded, path) MAX RECURSION LEVEL 100 AS (
 SELECT tree, run, at_tree, at_level, at_idx, 0, folded, CAST('' AS BINARY) FROM {runs}
 UNION ALL
 SELECT c.tree, c.run, n.parent_tree, n.parent_level, n.parent_idx, CAST(pmod(xxhash64(c.tree, c.run), n.parent_copies) AS INT),
  transform(c.folded, h -> IF(n.folds, sha2(concat(n.left, h, n.right), 256), h)), concat(c.path, unhex(n.left), unhex(n.right))
 FROM climb c JOIN {nodes} n ON n.tree = c.at_tree AND n.level = c.at_level AND n.idx = c.at_idx AND n.copy = c.at_copy)
SELECT tree, run, folded, path FROM climb WHERE at_tree IS NULL"""


def climb(manifest: dict[str, DataFrame]) -> DataFrame:
    """(tree, run, folded, path) for each run of leaves: what its leaves' ``seen`` hashes fold to, and the siblings' digests above the run, in bytes."""
    runs = manifest["runs"]
    spark = runs.sparkSession
    siblings = lambda x, i: (F.array_join(F.slice("digests", F.lit(1), i), ""), F.array_join(F.slice("digests", i + 2, F.lit(FAN)), ""))

    def fold(x: Column, i: Column) -> Column:
        left, right = siblings(x, i)
        return F.when(F.col("n") == 1, x["seen"]).otherwise(F.sha2(F.concat(left, x["seen"], right), 256))

    one = F.col("n") == 1
    base = runs.withColumn("digests", F.transform("leaves", lambda x: x["digest"])).select(
        "tree", "run", F.when(one, TOP).otherwise(F.col("tree")).cast("long").alias("at_tree"), F.when(one, 0).otherwise(1).alias("at_level"),
        F.when(one, F.col("tree")).otherwise(F.col("run")).alias("at_idx"), F.transform("leaves", fold).alias("folded"),
    )
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the climb has one row for each run and level, whatever the table holds
    try:
        return cut_lineage(spark.sql(CLIMB, runs=base, nodes=manifest["nodes"]))
    finally:
        spark.conf.set(limit, before)


def verified(docs: DataFrame, seen: Column | None = None, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of ``docs``.

    ``seen`` is the hash of a row as it is found later (``row_hash`` of its fields); the row is verified if it folds to the root.
    """
    manifest = build(docs, fields, doc_id, source, seen)
    runs, above, roots = manifest["runs"], climb(manifest), manifest["roots"]
    rows = runs.join(above, ["tree", "run"]).join(if_small(roots), "tree")
    rows = rows.select("*", F.transform("leaves", lambda x: x["digest"]).alias("digests")).select("*", F.posexplode("leaves").alias("place", "own"))
    proof = F.concat(F.array_join(F.slice("digests", F.lit(1), F.col("place")), ""), F.array_join(F.slice("digests", F.col("place") + 2, F.lit(FAN)), ""), F.lower(F.hex("path")))
    folded = F.element_at("folded", F.col("place") + 1)
    return rows.select(
        F.col("own.doc_id").alias("doc_id"), F.col("own.digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
