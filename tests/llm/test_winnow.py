import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from scour.functions.ranges import place, split_points
from scour.llm import queries, winnow
from tests.llm.conftest import FOLDER, ODD


def least(text):
    """(hash, position) pairs by the definition: the rightmost least hash of every window."""
    if not text:
        return []
    k, w = winnow.GRAM, winnow.WINDOW
    grams = [xxhash.xxh64_intdigest(text[i : i + k].encode(), seed=42) for i in range(max(1, len(text) - k + 1))]
    order = [(h - (h >> 63 << 64)) >> 7 for h in grams]
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        window = order[i : i + w]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        if (grams[at] >> 33, at) not in out[-1:]:
            out.append((grams[at] >> 33, at))
    return out


def dice(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def shown(pairs):
    return ",".join(str(h << winnow.HIGH | winnow.LAST - p) for h, p in pairs)


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (doc, text) in enumerate(rows):
        follows = rows[(i + 1) % len(rows)][1]
        n = len(text) // 3
        new = text[: len(text) - n] + follows[:n]
        mine, other = least(text), least(new)
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), shown(mine), shown(other), dice(mine, other), dice(mine, least(follows))))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r))


def test_query(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = got(queries.QUERIES["op11_fingerprints"](spark, FOLDER))
    assert found == brute(rows)
    long = [r for r in found if r[1] > 200]
    assert sum(r[5] > r[6] for r in long) > 0.95 * len(long)


def test_odd_texts(spark, odd):
    wanted = {i: t or "" for i, t in ODD}
    for r in winnow.fingerprints(odd).collect():
        found = list(zip(winnow_hashes(spark, r.packed), [winnow.LAST - (p & winnow.LOW) for p in r.packed]))
        assert found == least(wanted[r.doc_id]) and r.n_chars == len(wanted[r.doc_id])


def winnow_hashes(spark, packed):
    return [p >> winnow.HIGH for p in packed]


def test_lengths_around_stretches(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab🙂é\n") for _ in range(n)) for n in [*range(1, 36), 63, 64, 65, 79, 93, 94, 95, 127, 128, 129, 158, 159, 1000]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in winnow.fingerprints(df).select("doc_id", winnow.written(F.col("packed")).alias("p"), winnow.positions(F.col("packed")).alias("at")).collect():
        assert r.p == shown(least(texts[r.doc_id])) and r["at"] == [p for _, p in least(texts[r.doc_id])]


def test_match_guarantee(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(winnow.GRAM + winnow.WINDOW - 1)
    rows = [(i, text(rng.randrange(200)) + shared + text(rng.randrange(200))) for i in range(30)]
    sets = [set(r.h) for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select(winnow.hashes(F.col("packed")).alias("h")).collect()]
    assert set.intersection(*sets)


def test_repeated_and_null_ids(spark):
    """One row for each row; rows with one id go by their texts; a null id is the last in the order."""
    rows = [(3, "c" * 9), (2, "bb1"), (2, "aa1"), (None, None), (1, "zzz" * 100)]
    found = {(r.doc_id, r.n_chars, r.edited) for r in winnow.edited(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, at long, halo string")).collect()}
    assert found == {(3, 9, "c" * 6 + "aa1"), (2, 3, "aab"), (2, 3, "bbz"), (1, 300, "zzz" * 66 + "zz"), (None, 0, "")}
    assert winnow.edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (alone,) = winnow.edited(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert alone.edited == "abcdab"


def test_no_python_on_the_main_path(spark):
    plan = queries.QUERIES["op11_fingerprints"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edited_texts_of_all_lengths(spark, monkeypatch):
    """Shared windows are winnowed once; short and empty neighbours, many stretches of ids, ids far apart."""
    rng = random.Random(6)
    ids = rng.sample(range(-(2**61), 2**61), 400) + list(range(300))
    rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 2, 3, 20, 44, 45, 46, 47, 90, 300])))) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(winnow, "split_points", lambda d, c: split_points(d, c, rows=9))
    monkeypatch.setattr(winnow, "place", lambda v, p: place(v, p, fan=8))
    want = {r[0]: r for r in brute(rows)}
    shown_as = winnow.edited(df).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256), winnow.written(F.col("packed")), winnow.written(F.col("edited_packed")))
    found = shown_as.collect()
    assert len(found) == len(rows) and all(tuple(r) == want[r.doc_id][:5] for r in found)


def test_windows_taken_from_the_next_document(spark):
    """Only the ends of what was taken are winnowed again: gives of all lengths around the stretches, runs, many ties, wide characters."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "a", "abcdefgh🙂é\n") for n in [*range(355, 400, 3), 700, 1500]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    made = winnow.edited(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "next_packed" in plan
    want = {r[0]: r[4] for r in brute(rows)}
    assert {r.doc_id: r.p for r in made.select("doc_id", winnow.written(F.col("edited_packed")).alias("p")).collect()} == want


def test_plain_stretches_beside_wide_ones(spark):
    """Stretches of one byte a code point are cut as bytes, others as characters: both, mixed, of all lengths around a stretch, runs and ties."""
    rng = random.Random(10)
    size, reach = winnow.STRETCH, winnow.GRAM + winnow.WINDOW - 2
    lengths = [1, 15, 16, 17, 31, 32, *range(size - 2, size + 3), *range(size + reach - 2, size + reach + 3), *range(2 * size - 1, 2 * size + 2), *range(2 * size + reach - 1, 2 * size + reach + 2), 5 * size]
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "é🙂", "abcdefgh \n") for n in lengths]
    texts += ["a" * before + wide + "ab " * 200 for wide in ("é", "🙂", "\x7f", "\x80") for before in (0, size - 1, size, size + reach - 1, size + reach, 3 * size)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = winnow.fingerprints(df).select("doc_id", winnow.written(F.col("packed")).alias("p")).collect()
    assert {r.doc_id: r.p for r in found} == {i: shown(least(t)) for i, t in enumerate(texts)}


def test_work_a_gram(spark):
    """Grams of plain stretches are cut from bytes, and no array is copied for each doubling of the windows."""
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = df.select(winnow.winnowed(F.col("text")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert "as binary" in plan and plan.count("slice(") == 1 and "zip_with" not in plan
