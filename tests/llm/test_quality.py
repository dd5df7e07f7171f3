import random
import re

import numpy as np

from scour.llm import quality, queries

from tests.llm.conftest import FOLDER, ODD


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {w: windows.count(w) for w in set(windows)} if len(windows) < 3000 else {w: 2 for w in set(windows)}
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_equals_brute_force(spark, texts):
    rows = queries.QUERIES["op10_quality_rules"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept <= (not r.base_failed)


def test_odd_rows(odd, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    df, name = quality.judged(odd, quality.fit(odd, empty))
    assert df.columns == [*odd.columns, "_quality"] and name == "_quality"
    rows = df.collect()
    assert sorted(tuple(r[name])[:5] for r in rows) == sorted(brute(t) for _, t in ODD)
    assert quality.quality_filter(odd, empty).columns == odd.columns
    assert quality.quality_filter(odd.limit(0), empty).count() == 0


def test_learns_thresholds():
    rng = np.random.default_rng(0)
    x = {f: rng.random(3000) for f in quality.FEATURES}
    bad = (x["symbol_rate"] > 0.7) & (x["digit_rate"] <= 0.5) | (x["repeat_rate"] > 0.9)
    rules = quality.learn(x, bad)
    found = np.any([r.covers(x) for r in rules], axis=0)
    assert (found == bad).mean() > 0.98
    assert quality.learn(x, rng.random(3000) < 0.3) == []


def test_held_out_accuracy(spark):
    """Rules fitted on half of the labels, judged on the other half."""
    folder = FOLDER.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    df, name = quality.judged(docs, rules)
    rows = df.join(labels.where("doc_id % 2 = 1").select("doc_id", labels.quality.alias("good")), "doc_id").select("good", f"{name}.kept").collect()
    good = [r.kept for r in rows if r.good]
    bad = [r.kept for r in rows if not r.good]
    print(len(rules), sum(good) / len(good), 1 - sum(bad) / len(bad), [r.label for r in rules])
    assert sum(good) / len(good) > 0.97
    assert 1 - sum(bad) / len(bad) > 0.8
