"""What a Python worker holds: it serves all stages of a session, so each leaves little behind."""

import re
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from scour.llm import jaccard, packing, suffixes
from scour.llm.common import components, leaves_little, worker_cache
from scour.session import cut_lineage


class Here:
    """Hands out what would run in the workers."""

    def mapInArrow(self, run, schema):
        return run


def test_shingle_sets_leave_nothing_and_drop_what_other_stages_kept():
    worker_cache("another stage", lambda: ["large"])
    run = jaccard.signed_sets(Here(), jaccard.Likeness(3, 9, 10))
    (out,) = run([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c d", "e f"]})])
    assert out.column("n").to_pylist() == [2, 1]
    kept = worker_cache("probe", dict)
    assert worker_cache("another stage", list) == [] and worker_cache("words", dict) == {} == kept


def test_packing_keeps_a_bounded_table_and_the_same_ids():
    words, known = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json")), packing.KEPT_WORDS
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters[:10])
    first = words.of(text)
    assert len(words) <= known <= 100_000 < len(text.split())
    assert words.of(text) == first


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_free_memory_goes_back_after_a_group():
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
    pins = []

    def run(table):
        pieces = [bytes([i % 251]) * 20_000 for i in range(5000)]
        pins.append(pieces[-1])
        return table

    before = held()
    leaves_little(run)(pa.table({"a": [1]}))
    assert held() - before < 30 and len(pins) == 1
    assert leaves_little(lambda left, right: right)(pa.table({"a": [1]}), pa.table({"b": [2]})).column_names == ["b"]


def test_hashes_held_twice():
    rng = np.random.default_rng(5)
    lists = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 40, 90, 90)] + [np.arange(1000, 1010, dtype=np.uint64)]
    for i, mask in enumerate(suffixes._held_twice(lists)):
        others = np.concatenate(lists[:i] + lists[i + 1 :])
        assert mask.tolist() == np.isin(lists[i], others).tolist()
    assert [m.tolist() for m in suffixes._held_twice([np.array([7], np.uint64)])] == [[False]]


def test_links_are_written_before_the_next_python_step(spark, monkeypatch):
    plans = []

    def watched(edges):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return components(edges)

    monkeypatch.setattr(jaccard, "components", watched)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(0, 60, 6)]
    assert jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5).count() == len(rows)
    assert plans and not any("InArrow" in p for p in plans)


def test_packing_takes_whole_texts_in_small_batches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "cut_lineage", lambda df: (seen.append(spark.conf.get(packing.ARROW_ROWS)), cut_lineage(df))[1])
    before = spark.conf.get(packing.ARROW_ROWS)
    docs = spark.range(1200).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack_documents(docs, path).count() == 1200
    assert seen == [str(packing.BATCH_ROWS)] and spark.conf.get(packing.ARROW_ROWS) == before
    run, context = packing.pieces_of(Here(), path, with_ids=True), type("Context", (), {"partitionId": lambda self: 0})
    monkeypatch.setattr(packing.TaskContext, "get", staticmethod(lambda: context()))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "text": ["ok"] * 1200})
    out = list(run([batch]))
    assert max(b.num_rows for b in out) <= packing.BATCH_ROWS
    assert [u for b in out for u in b.column("uid").to_pylist()] == list(range(1200))
