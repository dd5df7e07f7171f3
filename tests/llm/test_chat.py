import hashlib
import random
import re

import pytest

from scour.llm import chat, queries

from tests.llm.conftest import FOLDER

SCHEMA = "conv_id long, turn int, role string, text string"
CONTROL = ["<|user|>", "|>", "</s>\n", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\\\", "<\\|", "<", "|", "[", "é🙂", "\n", "x", "<unk>", "|>\n"]


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=str)


def got(windows):
    return sorted((tuple(r)[:5] for r in chat.digests(windows).collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    found = queries.QUERIES["op5_chat_windows"](spark, FOLDER).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute(rows)
    assert all(r.formatted_chars > 0 for r in found)


@pytest.mark.parametrize("options", [dict(), dict(budget=40, history_turns=3, history_tokens=20), dict(budget=1, history_turns=0), dict(budget=10**6)])
def test_odd_conversations(spark, options):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(CONTROL) for _ in range(rng.randrange(6)))
    rows = [(1, i, rng.choice(["user", "assistant"]), text()) for i in range(300)] + [(1, 5, "user", "tie"), (1, 5, "user", "tie")]
    rows += [(2, -1, "system", "be brief"), *((2, i * 1000, ["user", "assistant"][i % 2], text()) for i in range(150))]
    rows += [(3, None, None, None), (3, None, "assistant", "early"), (3, 1, "assistant", None), (None, 1, "user", "x"), (None, 2, "assistant", "y" * 5000)]
    rows += [(4, 0, text(), text()), (4, 1, "assistant", "\\"), (5, 0, "system", "alone"), (6, 0, "assistant", "<")]
    assert got(chat.chat_windows(spark.createDataFrame(rows, SCHEMA), **options)) == brute(rows)


def test_windows(spark):
    rows = [(1, 0, "system", "s" * 16)] + [(1, i, "assistant" if i % 2 == 0 else "user", f"{i:03d}" + "w" * (i % 40)) for i in range(1, 200)]
    windows = chat.read_back(chat.chat_windows(spark.createDataFrame(rows, SCHEMA), budget=100, history_turns=2, history_tokens=30)).collect()
    cost = lambda t: -(-len(t) // 4) + 4
    assert len(windows) > 20
    for w in windows:
        written = [re.match(r"<\|(.*?)\|>\n(.*)", p, re.S).groups() for p in w.formatted.split("</s>\n")[:-1]]
        assert written[0] == ("system", "s" * 16)
        assert sum(cost(t) for _, t in written) <= 100
        repeated = written[1 : w.context] if (w.block, w.window) != (0, 0) else []
        assert len(repeated) <= 2 and sum(cost(t) for _, t in repeated) <= 30
        numbers = [int(t[:3]) for _, t in written[1:]]
        assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
        assert [w.formatted[s.start : s.end] for s in w.loss] == [t for r, t in written[w.context :] if r == "assistant"]
    assert any(w.context == 3 for w in windows)


def test_no_python_on_the_main_path_and_empty(spark):
    windows = chat.chat_windows(spark.createDataFrame([], SCHEMA))
    assert chat.digests(windows).count() == 0
    plan = queries.QUERIES["op5_chat_windows"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 9, 9, "z")], SCHEMA + ", idx int, block int, window string")
    assert got(chat.chat_windows(df)) == brute([(1, 0, "user", "a")])
