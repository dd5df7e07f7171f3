"""Repair of conversation structure: the cheapest edits after which roles go ``s?(ua)+``, or nothing is left.

Rows are dealt by conversation and sorted by turn; ``mapInPandas`` streams them and carries the state of a dynamic program
from one Arrow batch to the next. The grammar is an automaton of four states (nothing yet, after system, after user, after
assistant). In each state a row can be kept if its role fits, given the role that fits, or deleted, and an empty turn of the
role that fits can be put in front, so every state has one successor and a string of edits has one meaning. For each state
the program keeps the least cost of reaching it, the rank of that path's edits among the states' (paths differ within their common
length, so ranks are kept by a step and ties end at the smallest string), and a running hash of the repaired text. Steps
between equal vectors of costs and ranks are remembered, so a row costs a lookup and at most four updates of a hash.

Each row leaves four bytes of backpointers. A conversation that has left ``spill`` of them writes them out as rows of
the output table, in the shared folder like all other rows, and goes on; memory stays bounded for a conversation of any
length. A second stream over those rows alone, sorted backwards, reads its edits off. Only the string of edits of a
conversation, one letter a turn, ends up in one row, as asked.

Faults: a row is blank without any visible character, a duplicate if its role and text occur earlier in the conversation,
truncated if its last visible character is not ``.``, ``!`` or ``?``; the first that applies counts. Earlier rows are found by
a numbering inside (conversation, digest of role and text), which spreads a long conversation over tasks. The stream
itself reads a conversation in one task, as the method says; its work is linear in the rows.

Defined results: a null turn comes before all others; turns that are equal go by role, then text. A null role or text is one
space. A null conversation is a conversation. Extra columns take no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from scour.functions.columns import col
from scour.session import cut_lineage

SPILL = 4_000_000
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
# States: nothing yet, after system, after user, after assistant. The next role that may be written, by state.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}
VISIBLE = r"[^\x20\x09-\x0D]"
FAULTS = ("blank", "duplicate", "truncated")
REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, part long, end int, pointers binary"


def faulty(rows: DataFrame) -> DataFrame:
    """(key, known, turn, role, text, fault): rows with the first fault of each, a number in ``FAULTS`` counted from 1, else 0."""
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    out = rows.select(
        col("conv_id").cast("string").alias("key"), col("turn").isNotNull().alias("known"), F.coalesce(col("turn").cast("long"), F.lit(0)).alias("turn"),
        text("role").alias("role"), text("text").alias("text"),
    )
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    same = Window.partitionBy("key", digest).orderBy("known", "turn")
    out = out.withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(~F.col("text").rlike(VISIBLE), 1).when(F.col("again"), 2).when(F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z"), 0).otherwise(3)
    return out.select("key", "known", "turn", "role", "text", fault.alias("fault"))


class Steps(dict):
    """(costs and ranks of the four states, fault, role) -> (the same after the row, added cost, what each state came from)."""

    def __missing__(self, key: tuple) -> tuple:
        before, fault, initial = key
        best: dict[int, tuple] = {}
        for state, entry in enumerate(before):
            if entry is None:
                continue
            at, cost, letters = state, entry[0], ""
            for inserted in range(3):
                options = [(DELETE, at, 2)]
                if fault not in (1, 2):
                    extra = TRUNCATED_COST if fault == 3 else 0
                    if initial == NEXT[at] or (at, initial) == (EMPTY, SYSTEM):
                        options.append((KEEP, initial, extra))
                    options.append((REROLE, NEXT[at], COST[REROLE] + extra))
                for letter, to, price in options:
                    found = (cost + price, entry[1], letters + letter, state, inserted)
                    if to not in best or found < best[to]:
                        best[to] = found
                at, cost, letters = NEXT[at], cost + COST[INSERT], letters + INSERT
        least = min(f[0] for f in best.values())
        order = sorted(best, key=lambda s: best[s][1:3])
        after = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in range(4))
        value = (after, least, {s: (f[3], f[4], f[2][-1]) for s, f in best.items()})
        self[key] = value
        return value


def _packed(origin: tuple) -> int:
    state, inserted, letter = origin
    return state | inserted << 2 | "KRD".index(letter) << 4


def _walk_back(state: int, pointers: bytes) -> tuple[int, str]:
    """The state before the first of these rows, and their edits."""
    out = []
    for i in range(len(pointers) - 4, -1, -4):
        p = pointers[i + state]
        out.append("KRD"[p >> 4])
        out.append(INSERT * (p >> 2 & 3))
        state = p & 3
    return state, "".join(reversed(out))


class Conversation:
    """The program's state for one conversation; ``spilled`` collects rows of backpointers for the output."""

    def __init__(self, key: str | None, steps: Steps, limit: int) -> None:
        self.key, self.steps, self.limit = key, steps, limit
        self.vector: tuple = ((0, 0), None, None, None)
        self.cost, self.part = 0, 0
        self.hashes = {EMPTY: hashlib.sha256()}
        self.pointers = bytearray()
        self.faults = [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.turns: list[int] = []  # first, last, distinct
        self.spilled: list[tuple] = []

    def add(self, known: bool, turn: int, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if known:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        initial = INITIALS.get(role[:1])
        self.vector, added, origins = self.steps[self.vector, fault, initial]
        self.cost += added
        hashes, step = {}, bytearray(4)
        for state, origin in origins.items():
            came, inserted, letter = origin
            step[state] = _packed(origin)
            h = self.hashes[came].copy()
            at = came
            for _ in range(inserted):
                h.update(_line(at, ROLE[NEXT[at]], ""))
                at = NEXT[at]
            if letter != DELETE:
                h.update(_line(at, role if letter == KEEP else ROLE[NEXT[at]], text))
            hashes[state] = h
        self.hashes = hashes
        self.pointers += step
        if len(self.pointers) >= self.limit:
            self.spilled.append((self.key, *[None] * 8, self.part, None, bytes(self.pointers)))
            self.pointers = bytearray()
            self.part += 1

    def report(self) -> Iterator[tuple]:
        """The row of the conversation; its edits follow from the spilled rows if there are any."""
        ends = []
        for state, entry in enumerate(self.vector):
            at = state
            for inserted in range(3):
                if entry is not None and (at == ASSISTANT or state == at == EMPTY and inserted == 0):
                    ends.append((entry[0] + inserted * COST[INSERT], entry[1], inserted, state))
                at = NEXT[at]
        cost, _, inserted, state = min(ends)
        h, at = self.hashes[state].copy(), state
        for _ in range(inserted):
            h.update(_line(at, ROLE[NEXT[at]], ""))
            at = NEXT[at]
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        whole = self.part == 0
        audit = _walk_back(state, self.pointers)[1] + INSERT * inserted if whole else None
        yield (self.key, gaps, *self.faults[1:], self.illegal, self.cost + cost, audit, h.hexdigest(), self.part, state | inserted << 2, None if whole else bytes(self.pointers))


def _line(state: int, role: str, text: str) -> bytes:
    return f"{role}:{text}".encode() if state == EMPTY else f"\n{role}:{text}".encode()


def _streamed(batches: Iterable[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in REPORT.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in names if n not in ("key", "audit", "repaired_sha256", "pointers")})
    steps, now, out = Steps(), None, []
    for batch in batches:
        for key, *row in zip(*[batch[c].tolist() for c in ("key", "known", "turn", "role", "text", "fault")], strict=True):
            if now is None or key != now.key:
                if now is not None:
                    out += now.report()
                now = Conversation(key, steps, limit)
            now.add(*row)
            if now.spilled:
                yield frame(now.spilled)
                now.spilled = []
        if out:
            yield frame(out)
            out = []
    if now is not None:
        yield frame([*now.report()])


def _backwards(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of the spilled parts of conversations, whose parts come last first."""
    key, state, started = None, None, False
    for batch in batches:
        rows = []
        for k, part, end, pointers in zip(batch["key"].tolist(), batch["part"].tolist(), batch["end"].tolist(), batch["pointers"].tolist(), strict=True):
            tail = ""
            if not started or k != key:
                key, state, started = k, int(end) & 3, True
                tail = INSERT * (int(end) >> 2)
            state, edits = _walk_back(state, pointers)
            rows.append((k, part, edits + tail))
        yield pd.DataFrame(rows, columns=["key", "part", "piece"])


def repair(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation that has rows.

    ``key`` is the conversation's id as text. ``spill`` bounds the bytes of backpointers a task holds. ``audit`` has the edits' initials in order: the cheapest, and the smallest string of those.
    """
    dealt = faulty(rows).repartition("key").sortWithinPartitions("key", "known", "turn", "role", "text")
    done = cut_lineage(dealt.mapInPandas(lambda batches: _streamed(batches, spill), REPORT))
    spilled = done.where("pointers IS NOT NULL").select("key", "part", F.coalesce("end", F.lit(-1)).alias("end"), "pointers")
    pieces = spilled.repartition("key").sortWithinPartitions("key", F.desc("part")).mapInPandas(_backwards, "key string, part long, piece string")
    whole = pieces.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda p: p["piece"]), "").alias("pieced"))
    a, b = done.where("cost IS NOT NULL").alias("a"), whole.alias("b")
    joined = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")), "left")
    shown = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select("a.key", *[F.col(f"a.{c}") for c in shown], F.coalesce("a.audit", "b.pieced").alias("audit"), "a.repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """A drill: of the rows, dealt by a checksum of ``conv_id:turn`` into twentieths, the first is dropped, the second loses its text, the
    third its ``.!?``, the fourth is written twice, the fifth becomes the user's. A null is one space."""
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    lot = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("lot")
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), lot).where("lot <> 0")
    body = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), body.alias("text"), twice.alias("copy")).drop("copy")


def reports(ids: Column, every: DataFrame, found: DataFrame) -> DataFrame:
    """A report for every conversation of ``every``: zeros, no edits and the hash of nothing where no row was left."""
    kept = every.select(ids.alias("conv_id")).distinct()
    joined = kept.join(found, kept["conv_id"].cast("string").eqNullSafe(found["key"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts]
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
