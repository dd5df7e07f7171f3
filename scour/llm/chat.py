"""Chat formatting in windows of a token budget, with a loss mask.

All of it is DataFrame and SQL functions. A turn is written ``<|role|>``, newline, text, ``</s>``, newline. Control
strings inside roles and texts are escaped by a backslash after their first character, and backslashes are doubled,
so that a split at the markers and dropping the escapes gives back what went in.

Windows are chosen on prefix sums of turn tokens: a window takes turns as long as the sum since its first turn stays
within the budget, less what the system turn and the history may take; a turn is never cut, so one that is longer than
the budget fills a window alone. A system turn that opens a conversation stands in front of every window. Then come
the last turns before the window, at most ``history_turns`` whose sum is within ``history_tokens``. These repeated turns
are masked: the loss covers the assistants' texts of the window's own turns, each in one window only.

Conversations are cut into blocks of ``BLOCK`` turns that are windowed independently, so a conversation that
holds a third of all rows is spread over many tasks. Turns are numbered in two steps, inside runs of 256 turn numbers
and then over the counts of the runs.

Defined results: turns go by turn number, then role, then text; a null number comes first. A null text or role is
empty. A null conv_id is one conversation. Repeated rows are turns of their own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# What common chat templates and tokenizers use as control strings, after their first character.
CONTROL = r"(\\|<(?=\||/?s>|</?SYS>>|unk>|pad>)|\[(?=/?INST\])|\|(?=>))"
END = "</s>\n"
BLOCK = 64
RUN = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """The default cost of a turn: a token for four bytes, and four for its markers."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``idx``, the place of each turn in its conversation."""
    turns = turns.withColumn("run", F.floor(F.col("turn") / RUN))
    runs = turns.groupBy("conv_id", "run").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    inside = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    turns = turns.withColumn("rank", F.row_number().over(inside))
    a, b = turns.alias("a"), runs.alias("b")
    joined = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.run").eqNullSafe(F.col("b.run")))
    return joined.select("a.*", (F.col("b.offset") + F.col("a.rank") - 1).alias("idx")).drop("run", "rank")


def chat_windows(conversations: DataFrame, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256, tokens=turn_tokens) -> DataFrame:
    """(conv_id, block, window, context, formatted, loss): one row for each window.

    ``context`` is the number of repeated turns in front, ``loss`` the (start, end) code points in ``formatted`` under the mask.
    """
    if not 0 <= history_turns < BLOCK:
        raise ValueError(f"history_turns must be below {BLOCK}")
    turns = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = numbered(turns).select("conv_id", "idx", "role", escaped(F.col("role")).alias("head"), escaped(F.col("text")).alias("body"), tokens(F.col("text")).alias("tokens"))
    system = turns.where("idx = 0 AND role = 'system'").select("conv_id", F.struct("head", "body", F.lit(False).alias("learn"), F.lit(True).alias("old")).alias("system"), F.col("tokens").alias("system_tokens"))
    # The last turns of a block are the history of the next one.
    block = F.floor(F.col("idx") / BLOCK)
    homes = F.when(F.col("idx") % BLOCK >= BLOCK - history_turns, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = turns.withColumn("block", F.explode(homes))
    row = F.struct("idx", "head", "body", "tokens", (F.col("role") == "assistant").alias("learn"), ((F.col("idx") == 0) & (F.col("role") == "system")).alias("opens"))
    blocks = dealt.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(row)).alias("turns")).where(F.element_at("turns", -1)["idx"] >= F.col("block") * BLOCK)
    a, b = blocks.alias("a"), system.alias("b")
    blocks = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").select("a.*", "b.system", F.coalesce("b.system_tokens", F.lit(0)).alias("system_tokens"))
    room = F.greatest(F.lit(budget) - F.col("system_tokens") - F.lit(history_tokens if history_turns else 0), F.lit(1))
    blocks = blocks.withColumn("placed", _placed(F.col("turns"), F.col("block") * BLOCK, room))
    windows = blocks.withColumn("window", F.explode(F.sequence(F.lit(0), F.element_at("placed", -1)["window"])))
    mine = F.filter("placed", lambda t: t["window"] == F.col("window"))
    windows = windows.withColumn("own", mine).withColumn("first", F.col("own")[0])
    begin = F.col("first.sum") - F.col("first.tokens")
    recent = F.filter("placed", lambda t: (t["idx"] < F.col("first.idx")) & (t["idx"] >= F.col("first.idx") - history_turns) & (begin - t["sum"] + t["tokens"] <= history_tokens) & ~t["opens"])
    repeats = F.when(F.col("system").isNotNull() & (F.col("first.idx") > 0), F.array("system")).otherwise(F.array().cast(_SHOWN))
    shown = F.concat(repeats, F.transform(recent, lambda t: _shown(t, True)), F.transform("own", lambda t: _shown(t, False)))
    windows = windows.select("conv_id", "block", "window", shown.alias("shown"))
    return windows.select(
        "conv_id", "block", "window", F.size(F.filter("shown", lambda t: t["old"])).alias("context"),
        F.array_join(F.transform("shown", _written), "").alias("formatted"), _mask(F.col("shown")).alias("loss"),
    )


_SHOWN = "array<struct<head:string,body:string,learn:boolean,old:boolean>>"


def _shown(t: Column, old: bool) -> Column:
    return F.struct(t["head"].alias("head"), t["body"].alias("body"), (t["learn"] & F.lit(not old)).alias("learn"), F.lit(old).alias("old"))


def _front(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["head"], F.lit("|>\n"))


def _written(t: Column) -> Column:
    return F.concat(_front(t), t["body"], F.lit(END))


def _placed(turns: Column, first: Column, room: Column) -> Column:
    """The turns with ``sum``, the tokens up to and with each, and ``window``; turns of the block before have window -1."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("base"), F.lit(-1).alias("window"), F.array().cast("array<struct<sum:bigint,window:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        total = acc["sum"] + t["tokens"]
        own = t["idx"] >= first
        opens = own & ((acc["window"] < 0) | (total - acc["base"] > room))
        window = F.when(opens, acc["window"] + 1).otherwise(acc["window"])
        return F.struct(total.alias("sum"), F.when(opens, acc["sum"]).otherwise(acc["base"]).alias("base"), window.alias("window"), F.concat(acc["out"], F.array(F.struct(total.alias("sum"), window.alias("window")))).alias("out"))

    marks = F.aggregate(turns, start, step, lambda acc: acc["out"])
    return F.zip_with(turns, marks, lambda t, m: F.struct(*[t[c].alias(c) for c in ("idx", "head", "body", "tokens", "learn", "opens")], m["sum"].alias("sum"), m["window"].alias("window")))


def _mask(shown: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_front(t))
        end = begin + F.length(t["body"])
        return F.struct((end + len(END)).alias("at"), F.when(t["learn"], F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(shown, start, step, lambda acc: acc["out"])


def read_back(windows: DataFrame) -> DataFrame:
    """``windows`` with ``turns``, the (role, text) of their own turns, and ``learned``, the text under the mask; both from the output alone."""
    pieces = F.split(F.col("formatted"), F.lit(END), -1)
    own = F.slice(pieces, F.col("context") + 1, F.size(pieces) - F.col("context") - 1)

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"\|>\n", 2)
        return F.struct(unescaped(F.substring(parts[0], F.lit(3), F.length(parts[0]))).alias("role"), unescaped(parts[1]).alias("text"))

    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return windows.withColumn("turns", F.transform(own, turn)).withColumn("learned", F.array_join(learned, ""))


def digests(windows: DataFrame) -> DataFrame:
    """What each conversation reads back as: its turns, the learned text and their hashes.

    A hash covers a whole conversation, so the texts of one meet in one row; blocks are joined first.
    """
    rows = read_back(windows).select(
        "conv_id", "block", "window", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        "learned", F.length("formatted").cast("long").alias("chars"),
    )
    for keys, order in ((["conv_id", "block"], "window"), (["conv_id"], "block")):
        part = F.array_sort(F.collect_list(F.struct(order, "said", "learned")))
        rows = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), part.alias("parts"))
        rows = rows.select(*keys, "n", "chars", *[F.array_join(F.transform("parts", lambda p: p[c]), "").alias(c) for c in ("said", "learned")])  # noqa: B023
    return rows.select(
        "conv_id", F.col("n").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )
