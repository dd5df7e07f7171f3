import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from scour.llm import manifest, queries
from tests.llm.conftest import FOLDER

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root, and for each leaf its siblings as (left, right), level by level."""
    paths, spot, n = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(n) > 1:
        for path, i in zip(paths, range(len(paths))):
            run = spot[i] // 16 * 16
            path.append(("".join(n[run : spot[i]]), "".join(n[spot[i] + 1 : run + 16])))
            spot[i] //= 16
        n = [H(*n[i : i + 16]) for i in range(0, len(n), 16)]
    return n[0], paths


def brute(rows, tampered):
    out, sources = [], sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in g]) for s, g in groups.items()}
    root, above = tree([trees[s][0] for s in sources])
    for s, up in zip(sources, above):
        for r, path in zip(groups[s], trees[s][1]):
            folded = leaf(tampered(r))
            for left, right in path + up:
                folded = H(left, folded, right)
            out.append((r[0], leaf(r), trees[s][0], root, H(*(a + b for a, b in path + up)), folded, folded == root))
    return sorted(out, key=str)


def lowered(r):
    if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 or r[4] is None:
        return r
    return (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))


def seen():
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, text).otherwise(F.col("text"))
    return manifest.row_hash([text if f == "text" else F.col(f) for f in manifest.FIELDS])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*manifest.FIELDS).collect()]
    got = queries.QUERIES["op12_merkle_manifest"](spark, FOLDER).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, lowered)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("copy", [1, 64])
def test_hot_source_and_odd_rows(spark, monkeypatch, copy):
    """Three levels in one source, single rows in others, nulls everywhere, equal rows, many sources; copies of hot nodes."""
    monkeypatch.setattr(manifest, "COPY", copy)
    rows = [(i, "hot", "en", i, f"Text {i} Ü\n") for i in range(700)] + [(i, f"s{i}", None, None, "X" * i) for i in range(40)]
    rows += [(5, None, "de", 3, None), (None, None, None, None, None), (7, "", "", 0, ""), (7, "", "", 0, ""), (2**40, "é", "z", -1, "A🙂" * 5000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", digest int, tree string").repartition(5)
    assert sorted(map(tuple, manifest.verified(df, seen()).collect()), key=str) == brute(rows, lowered)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_trees(spark, n):
    rows = [(i, "a", "en", 1, f"t{i}") for i in range(n)]
    got = manifest.verified(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == (brute(rows, lambda r: r) if n else [])
    assert all(r.verified for r in got)


def test_row_limit_of_recursion_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    manifest.verified(spark.createDataFrame([(1, "a", "b", 1, "c"), (2, "a", "b", 1, "c")], SCHEMA)).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
