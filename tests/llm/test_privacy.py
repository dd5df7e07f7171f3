import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from scour.llm import privacy, queries

from tests.llm.conftest import FOLDER, ODD

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def good(kind, value):
    d = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return True


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if good(kind, m.group())]
    return [f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in sorted(spans)]


TRICKY = [
    "a@b.c_d@e.f x@y a@b@c.d.e- .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.000255 1..2.3.4", "4111 1111-1111 1111 4111111111111112 0000-0000-0000", "+1 (988) 555-2485. +12 3 ++49 30 1234567 +1-)",
    "é🙂 +1 (988) 555-2485é a@b.cd 🙂1.2.3.4", "7" * 20000, "a" * 20000 + "@b.c", "1 " * 9000, "a.b@" * 3000, "x@" + "a." * 5000 + "z", "+" + "1 " * 9000, "4111111111111111" * 2, "1.1.1.1@a.b +4111111111111111",
]


@pytest.mark.parametrize("part", ["tricky", "odd", "table"])
def test_base_equals_plain_patterns(spark, texts, part):
    rows = {"tricky": list(enumerate(TRICKY)), "odd": ODD, "table": list(texts.items())}[part]
    df, name = privacy.personal_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    base = privacy.spans_text(privacy.F.filter(name, lambda s: s["kind"] < 4))
    got = sorted((str(r.doc_id), r.text or "", r.b) for r in df.select("doc_id", "text", base.alias("b")).collect())
    assert got == sorted((str(i), t or "", ",".join(brute(t))) for i, t in rows)


@pytest.mark.parametrize("make", ["addresses", "words"])
def test_time_grows_with_the_matches(spark, make):
    def seconds(n):
        text = " ".join(f"10.0.{i % 256}.{i // 256}" if make == "addresses" else f"word{i}" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        spans = privacy.base_spans(F.col("text")) if make == "addresses" else privacy.located(F.col("text"), privacy.WORD)
        begun = time.monotonic()
        assert df.select(spans.alias("s")).select(F.size("s")).first()[0] == n
        return time.monotonic() - begun

    seconds(1000)
    assert seconds(60000) < 6 * seconds(15000)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_and_masked(spark, n):
    numbers = [(i * 7) % 11 for i in range(n)]
    df = spark.createDataFrame([(numbers, "é🙂." * n)], "n array<int>, text string")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((i * 3).alias("start"), F.lit(0).alias("kind"), (i * 3 + i % 3).alias("end"), F.lit("").alias("value")))
    r = df.select(privacy.running(F.col("n"), lambda a, b: a + b).alias("sums"), privacy.masked(F.col("text"), F.filter(cuts, lambda c: c["end"] <= F.length("text"))).alias("m")).first()
    assert r.sums == [sum(numbers[:i]) for i in range(n)]
    assert r.m == "".join(privacy.MASK * (i % 3) + "é🙂."[i % 3 :] for i in range(n))


def test_query(spark, texts):
    rows = queries.QUERIES["op4_personal_data"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k, _ in PLAIN]
        assert set(want) <= set(r.spans.split(","))


def test_terms_that_disclose(spark):
    filler = ["the house stands by the river and the road", "a long road by the river leads to the house", "the river and the road and the house"]
    rows = [(i, f"{filler[i % 3]} {i}") for i in range(60)]
    rows += [(100, "the road Zorblatt writes from z@mail.example about the river"), (101, "by the house Zorblatt has z@mail.example and the road")]
    rows += [(102, "copied Quux has q@mail.example by the river"), (103, "copied Quux has q@mail.example by the river")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df, name = privacy.personal_spans(docs)
    found = {r.doc_id: [(s.value, s.kind) for s in r[name]] for r in df.collect()}
    assert found[100] == [("Zorblatt", 5), ("z@mail.example", 0)] and found[101] == [("Zorblatt", 5), ("z@mail.example", 0)]
    assert found[102] == [("q@mail.example", 0)] and found[0] == []
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert clean[100] == "the road  writes from [EMAIL] about the river" and clean[0] == rows[0][1]
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs, remove_at=2.0).collect()}
    assert clean[101] == "by the house [NAME] has [EMAIL] and the road"


def test_terms_far_off_and_alone(spark):
    filler = ["the house stands by the river and the road", "a long road by the river leads to the house", "the river and the road and the house"]
    far = " ".join(filler) + " "
    rows = [(i, f"{filler[i % 3]} {i}") for i in range(60)]
    rows += [(100, f"the road Zorblatt {far * 2}from z@mail.example about the river, Zorblatt"), (101, f"by z@mail.example the house {far * 3}Zorblatt and the road")]
    rows += [(102, "zorblatt alone by the river"), (103, "one Once and q@mail.example by the road, then again q@mail.example at the house Once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df, name = privacy.personal_spans(docs, generalise_at=0.8, remove_at=0.85)
    found = {r.doc_id: [(s.value, s.kind) for s in r[name]] for r in df.collect()}
    assert found[100] == [("Zorblatt", 5), ("z@mail.example", 0), ("Zorblatt", 5)]
    assert found[101] == [("z@mail.example", 0), ("Zorblatt", 5)] and found[102] == [("zorblatt", 5)]
    assert ("river", 5) not in found[0] and found[0] == []


def test_no_python_on_the_main_path(documents):
    plan = privacy.personal_spans(documents)[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_columns_and_empty(odd):
    assert privacy.sanitised(odd).columns == odd.columns
    assert privacy.sanitised(odd.limit(0)).count() == 0
