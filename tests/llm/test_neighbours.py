import numpy as np
import pytest

from scour.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, asked, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if q in asked:
            every = sorted((-float((x * y).sum()), j) for j, y in rows if j != q)
            out[q] = [(j, -s) for s, j in every[:k]]
    return out


def recall(found, want):
    return sum(len({j for j, _ in found.get(q, [])} & {j for j, _ in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("folder,least", [("sf0.01", 1.0), ("sf0.1", 0.95)])
def test_query_recall(spark, folder, least):
    path = f"/root/testdata/{folder}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    found = collected(queries.QUERIES["op6_nearest_neighbours"](spark, path))
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        want[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order]
    assert set(found) == set(want)
    got = recall(found, want)
    print(folder, got)
    assert got >= least
    place = {i: k for k, i in enumerate(ids.tolist())}
    for q, best in found.items():
        assert all(abs(s - x[place[q]] @ x[place[j]]) < 1e-12 for j, s in best)


def test_hot_vector_and_tiles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100)] + [(i, rng.standard_normal(4).tolist()) for i in range(100, 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = collected(neighbours.nearest(df, df.where("vec_id % 7 = 0"), k=5, candidates=10**6, tile_bytes=1280, query_rows=10))
    want = brute(rows, {i for i in range(300) if i % 7 == 0}, 5)
    assert {q: [j for j, _ in v] for q, v in found.items()} == {q: [j for j, _ in v] for q, v in want.items()}


def test_odd_rows(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    good = [(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 0.0]), (12, [1.0, 0.0]), (13, [-0.0, 5.0]), (14, [100.0, 100.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in bad + good], SCHEMA + ", rank int, tile string")
    found = collected(neighbours.nearest(df, df.where("vec_id < 12"), k=20))
    assert found == {10: [(14, 100.0), (12, 1.0), (11, 0.0), (13, 0.0)], 11: [(14, 100.0), (13, 5.0), (10, 0.0), (12, 0.0)]}
    assert neighbours.nearest(df.limit(0), df).count() == 0
    assert neighbours.nearest(df, df.limit(0)).count() == 0


def test_tables_find_all_within_a_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (500, 4)).astype(np.uint8)
    tables = neighbours.Tables(codes)
    for code in codes[:20]:
        distance = np.bitwise_count(codes ^ code).sum(axis=1)
        found = np.zeros(len(codes), bool)
        for reach in range(9):
            found |= tables.ring(code, reach)
            assert found[distance < 4 * (reach + 1)].all()
        for wanted in (1, 50, 500, 9999):
            near = tables.nearest_codes(code, wanted)
            assert len(near) >= min(wanted, 500) and set(near) == set(np.flatnonzero(distance <= distance[near].max()))
