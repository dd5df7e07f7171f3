"""The pipeline stage by stage against brute force; each stage is judged on what the one before kept."""

import re

import corpus_pipeline
import numpy as np
import pytest

from scour.llm import quality
from scour.session import cut_lineage

from tests.llm import test_jaccard, test_packing, test_privacy, test_quality, test_suffixes
from tests.llm.conftest import FOLDER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of documents and of each stage."""
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [df]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], FOLDER)))
    return [d.collect() for d in out]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "pii", "packing"]
    for rows in stages[:-1]:
        assert rows and rows[0].__fields__ == COLUMNS


def features(text):
    n, chars, symbols, dup, repeat = test_quality.brute(text)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    return {
        "n_words": n, "mean_word": chars / max(n, 1), "symbol_rate": symbols / max(n, 1), "dup_line_rate": dup / max(len(lines), 1), "repeat_rate": repeat / max(n, 1),
        "digit_rate": len(re.findall("[0-9]", text)) / max(chars, 1), "distinct_rate": len(set(words)) / max(n, 1), "line_words": n / max(len(lines), 1),
        "longest_word": max((len(w.encode()) for w in words), default=0),
    }


def test_quality_stage(spark, stages):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    want = []
    for r in stages[0]:
        text = r.text or ""
        n, _, _, _, repeat = test_quality.brute(text)
        x = {k: np.array([float(v)]) for k, v in features(text).items()}
        if n >= 10 and 100 * repeat <= 20 * n and not any(rule.covers(x)[0] for rule in rules):
            want.append(tuple(r))
    assert sorted(map(tuple, stages[1])) == sorted(want)


def test_near_duplicates_stage(stages):
    found = test_jaccard.brute([(r.doc_id, r.text) for r in stages[1]], 5, 4, 5)
    first = {i for i, _, c in found if i == c}
    assert sorted(map(tuple, stages[2])) == sorted(tuple(r) for r in stages[1] if r.doc_id in first)
    assert len(first) < len(found)


def test_repeated_passages_stage(stages):
    want = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in test_suffixes.brute([(r.doc_id, r.text) for r in stages[2]])}
    assert {r.doc_id: r.text for r in stages[3]} == want
    assert all(r.n_chars == len(r.text) for r in stages[3] if r.text)


def test_personal_data_stage(stages):
    before = {r.doc_id: r.text for r in stages[3]}
    touched = 0
    for r in stages[4]:
        spans = test_privacy.brute(before[r.doc_id])
        if not spans:
            assert r.text == before[r.doc_id]
            continue
        touched += 1
        for s in spans:
            kind, a, b = s.split(":")
            assert before[r.doc_id][int(a) : int(b)] not in r.text and "[" in r.text
    assert touched and len(stages[4]) == len(before)


def test_packing_stage(stages):
    test_packing.check(stages[5], {r.doc_id: r.text or "" for r in stages[4]}, 2048)


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() == len(stages[5])
