import hashlib
import random

import numpy as np
import pytest

from scour.llm import queries, suffixes

from tests.llm.conftest import FOLDER, ODD


def brute(rows, match=50):
    """(id, bytes, removed, spans, kept) by a dictionary of all windows."""
    rows = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in rows:
        for p in range(len(t) - match + 1):
            w = t[p : p + match]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - match + 1):
            if least[t[p : p + match]] < i:
                gone[p : p + match] = 1
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


def got(df, **options):
    found, name = suffixes.repeated_spans(df, **options)
    rows = []
    for r in found.select("doc_id", name).collect():
        s = r[name]
        removed = sum(e - b for b, e in zip(s.starts, s.ends))
        rows.append((2**63 - 1 if r.doc_id is None else r.doc_id, len(s.kept) + removed, removed, len(s.starts), bytes(s.kept)))
    return sorted(rows)


def test_table_equals_brute_force(spark, texts):
    want = [(i, n, r, s, hashlib.sha256(k).hexdigest()) for i, n, r, s, k in brute(texts.items())]
    assert sorted(tuple(r) for r in queries.QUERIES["op3_suffix_dedup"](spark, FOLDER).collect()) == want
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("match", [32, 50, 51])
def test_planted_passages(spark, monkeypatch, match):
    monkeypatch.setattr(suffixes, "SORT_WINDOWS", 500)
    rng = random.Random(match)
    word = lambda: rng.choice(["the ", "of ", "née ", "ab", "c\n"])
    passages = ["".join(word() for _ in range(rng.randrange(10, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randrange(9) :] if rng.random() < 0.4 else "".join(word() for _ in range(20)) for _ in range(rng.randrange(1, 5))]
        rows.append((rng.randrange(1000), "".join(parts)))
    rows += [(7, "ab" * 200), (3, "ab" * 150), (9, "x" * 300), (9, "x" * 300)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), match=match) == brute(rows, match)


def test_odd_rows(odd):
    assert got(odd) == brute(ODD)


def test_blocks(spark, monkeypatch, texts):
    """Many blocks and buckets over small data."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 20_000)
    rows = list(texts.items())
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_blocks_stay_small():
    """Two workers of an executor hold a block each, whatever the size of the input."""
    assert [suffixes._block_bytes(total) for total in (0, 10**9, 30 * 10**9, 10**14)] == [4_000_000, 4_000_000, 30 * 10**9 // 4096, 16_000_000]


def test_hashes_fill_all_buckets_alike():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(60)]
    sizes = np.diff(suffixes._cuts(suffixes.Block(np.arange(60), texts=[t.encode() for t in texts], match=50).hashes, 16))
    assert sizes.min() > 0.7 * sizes.mean() and sizes.max() < 1.3 * sizes.mean()


def test_text_stays_readable(odd, spark):
    kept = suffixes.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    cut = spark.createDataFrame([(1, "é" * 40), (2, "zé" + "é" * 40)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffixes.without_repeats(cut).collect()} == {1: "é" * 40, 2: "z"}
    cut = spark.createDataFrame([(1, "é" * 40), (2, "ĩ" + "é" * 40 + "end")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffixes.without_repeats(cut).collect()} == {1: "é" * 40, 2: "end"}
    # The replacement character is a character like any other.
    cut = spark.createDataFrame([(1, "é" * 40), (2, "\ufffdĩ" + "é" * 40 + "\ufffd🙂" + "é" * 40 + "a\ufffd")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffixes.without_repeats(cut).collect()} == {1: "é" * 40, 2: "\ufffd\ufffd🙂a\ufffd"}
    assert suffixes.without_repeats(odd.limit(0)).count() == 0


def test_sort_finds_equal_windows():
    text = b"abcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabc" + bytes(range(60))
    starts = np.arange(len(text) - 31)
    index, group = suffixes.equal_windows(text, starts, 32)
    want = {}
    for s in starts:
        want.setdefault(text[s : s + 32], []).append(s)
    assert sorted(sorted(index[group == g].tolist()) for g in set(group)) == sorted(v for v in want.values() if len(v) > 1)
