"""Token counts by a finite-state transducer.

A byte-pair vocabulary of whole words is compiled into a deterministic transducer over bytes. The encoding of a
word's prefix ends in one token only: the one that ends there and goes together with the last token of the
encoding before it. Two tokens go together when their bytes, merged afresh, give the two back. So what the
transducer must know about a prefix is finite: its longest ending with which a token may begin, and at each place
in that ending the last token and how many tokens fewer there were. Its transitions carry the change of the token
count, its final transitions the change at the end of a word, where the last byte carries the end mark. States
are made when they are first reached.

A text is cut into chunks. The state map of a chunk is (head, count, tail): white space resets the transducer, so
from any state a chunk runs its head from there, adds the count of what lies between its first and last white
space and stops in the state after its tail. In a chunk without white space the ends of words do the same. Heads
and tails are kept as text. Maps compose, composition is associative, and the maps of a document are folded as a
tree. Chunks of long documents are spread over tasks; only their maps meet again. A single word longer than a chunk
is put together again and counted by one task, in memory of its length.

Special tokens inside a text count one each, as the library has it by default.

Defined results: a null or empty text has no bytes and no tokens. Rows are counted one by one. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scour.llm.common import texts_of, worker_cache

CHUNK = 65_536
LETTERS = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĸĺļľŀłńņňŋōŏőŕŗřśŝşšţťŧũūŭůűųŵŷźżžſ"
# Texts in which every character is one of these are parted by the faster of two equal rules; none of them composes.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-Ýß-öø-ÿ]*\Z")
# How the tokenizer parts words after normalisation.
WORDS = re.compile(rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}0-9]+")
ANY_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\s")
KEPT_WORDS = 400_000
KEPT_STATES = 150_000


class State:
    """What the transducer knows: see ``Transducer``."""

    __slots__ = ("drops", "ending", "final", "steps", "tokens")

    def __init__(self, ending: bytes, tokens: tuple[int | None, ...], drops: tuple[int, ...]):
        self.ending, self.tokens, self.drops = ending, tokens, drops
        self.steps: dict[int, tuple[State, int]] = {}
        self.final: int | None = None


class Transducer:
    """Bytes of a word in, the number of its tokens out.

    ``tokens[k]`` is the last token of the prefix that stops ``k`` bytes into the ending (None for the empty
    prefix) and ``drops[k]`` how many tokens the whole prefix has more than that one.
    """

    def __init__(self, vocabulary: dict[bytes, int], closed: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.open, self.closed, self.merges = vocabulary, closed, merges
        self.bytes = {i: (t, False) for t, i in vocabulary.items()} | {i: (t, True) for t, i in closed.items()}
        self.beginnings = {t[:k] for t in (*vocabulary, *closed) for k in range(len(t) + 1)}
        self.edges: dict[int, tuple] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.start = self._state(b"", (None,), (0,))

    def _state(self, ending: bytes, tokens: tuple, drops: tuple) -> State:
        key = (ending, tokens, drops)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(*key)
        return found

    def spines(self, token: int) -> tuple[bool, list[tuple[int, float]], list[tuple[int, float]]]:
        """Whether the token's bytes merge into it, and the symbols at its left and right edge while they do.

        Byte-pair merging goes lowest rank first, leftmost first. Each edge symbol comes with the rank of the merge
        that takes it up; the token itself is never taken up.
        """
        if (known := self.edges.get(token)) is not None:
            return known
        text, end = self.bytes[token]
        row: list[tuple] = [(self.open[bytes([b])], None, None, None) for b in text]
        if end:
            row[-1] = (self.closed[text[-1:]], None, None, None)
        while len(row) > 1:
            ranked = [(self.merges[a[0], b[0]][0], k) for k, (a, b) in enumerate(zip(row, row[1:], strict=False)) if (a[0], b[0]) in self.merges]
            if not ranked:
                break
            rank, k = min(ranked)
            row[k : k + 2] = [(self.merges[row[k][0], row[k + 1][0]][1], rank, row[k], row[k + 1])]
        edges = []
        for side in (2, 3):
            node, taken, edge = row[0 if side == 2 else -1], float("inf"), []
            while node is not None:
                edge.append((node[0], taken))
                taken, node = node[1], node[side]
            edges.append(edge)
        known = self.edges[token] = (len(row) == 1 and row[0][0] == token, *edges)
        return known

    def together(self, before: int | None, token: int) -> bool:
        """Whether merging the bytes of the two tokens, one after the other, gives the two.

        It does not if a symbol at the right edge of the first ever meets one at the left edge of the second
        and they merge before either is taken up; of equal ranks the left one goes first.
        """
        key = (before, token)
        if (known := self.pairs.get(key)) is None:
            whole, left, _ = self.spines(token)
            if whole and before is not None:
                right = self.spines(before)[2]
                whole = not any((m := self.merges.get((x, y))) is not None and m[0] < gone and m[0] <= taken for x, gone in right for y, taken in left)
            known = self.pairs[key] = whole
        return known

    def _last(self, state: State, text: bytes, tokens: dict[bytes, int]) -> tuple[int, int]:
        """The token that ends ``text`` and goes with the one before it, and the drop at the place before it."""
        for k in range(len(text)):
            token = tokens.get(text[k:])
            if token is not None:
                before, drop = state.tokens[k], state.drops[k]
                if self.together(before, token):
                    return token, drop
        raise ValueError(f"the vocabulary has no encoding of {text!r}")

    def step(self, state: State, byte: int) -> tuple[State, int]:
        """Follow, or make, the transition on a byte."""
        text = state.ending + bytes([byte])
        token, drop = self._last(state, text, self.open)
        emitted = 1 - drop
        cut = next(k for k in range(len(text) + 1) if text[k:] in self.beginnings)
        tokens = (*state.tokens[cut:], token) if cut <= len(state.ending) else (token,)
        drops = (*(d + emitted for d in state.drops[cut:]), 0) if cut <= len(state.ending) else (0,)
        made = state.steps[byte] = (self._state(text[cut:], tokens, drops), emitted)
        return made

    def end(self, state: State) -> int:
        """Follow, or make, the final transition: the last byte takes the end mark."""
        text = state.ending
        _, drop = self._last(state, text, self.closed)
        state.final = 1 - drop
        return state.final

    def run(self, word: bytes) -> int:
        state, count = self.start, 0
        for byte in word:
            made = state.steps.get(byte) or self.step(state, byte)
            state = made[0]
            count += made[1]
        return count + (self.end(state) if state.final is None else state.final)


def _byte_names() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter(dict):
    """Token counts of texts by a tokenizer file; remembers the counts of words."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, names = spec["model"], _byte_names()
        mark = model["end_of_word_suffix"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or not mark:
            raise ValueError("a vocabulary of lower-case words with an end mark is needed")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        added = {t["content"] for t in spec["added_tokens"]}
        if any(t[0] != "<" for t in added):
            raise ValueError("special tokens are expected to begin with <")
        self.room = max(map(len, added), default=0)
        vocabulary, closed = {}, {}
        for text, i in model["vocab"].items():
            if text not in added:
                end = text.endswith(mark)
                (closed if end else vocabulary)[bytes(names[c] for c in (text[: -len(mark)] if end else text))] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = {(model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(pairs)}
        self.transducer = Transducer(vocabulary, closed, merges)

    def __missing__(self, word: str) -> int:
        count = self.transducer.run(word.encode())
        if len(self.transducer.states) > KEPT_STATES:
            self.transducer.reset()
        if len(word) <= 64 and len(self) < KEPT_WORDS:
            self[word] = count
        return count

    def of(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.special is not None and "<" in text and (found := self.special.findall(text)):
            return len(found) + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if PLAIN.match(text):
            words = WORDS.findall(text.lower())
        else:
            # One character at a time: a sigma at the end of a word is like any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            words = ANY_WORDS.findall(text)
        return sum(map(self.__getitem__, words))


class StateMap(NamedTuple):
    """What a chunk does to the transducer; ``count`` is None where no white space resets it."""

    head: str
    count: int | None
    tail: str


def _kind(c: str) -> str:
    """L for letters, N for numbers, O for others; empty for what normalisation may change or join to its neighbours."""
    kind = unicodedata.category(c)[0]
    if kind == "M" or "\u1100" <= c <= "\u11ff" or len(c.lower()) > 1 or unicodedata.normalize("NFC", c) != c:
        return ""
    return kind if kind in "LN" else "O"


def _parts_words(text: str, at: int, room: int) -> bool:
    """Whether a word ends before ``at`` whatever stands around ``text``; no special token of up to ``room`` characters reaches across."""
    before, after = _kind(text[at - 1]), _kind(text[at])
    if not before or not after or before == after != "N" or (text[at - 1] == "'" and after == "L"):
        return False
    return at >= room and "<" not in text[at - room : at]


def state_map(chunk: str, counter: Counter) -> StateMap:
    first = SPACE.search(chunk)
    if first is None:
        # Without white space, ends of words reset the transducer too.
        places = range(max(counter.room, 1), len(chunk))
        low = next((i for i in places if _parts_words(chunk, i, counter.room)), None)
        if low is None:
            return StateMap(chunk, None, "")
        high = next(i for i in reversed(places) if _parts_words(chunk, i, counter.room))
        return StateMap(chunk[:low], counter.of(chunk[low:high]), chunk[high:])
    last = next(i for i in range(len(chunk) - 1, -1, -1) if SPACE.match(chunk[i]))
    return StateMap(chunk[: first.start()], counter.of(chunk[first.start() : last + 1]), chunk[last + 1 :])


def composed(a: StateMap, b: StateMap, counter: Counter) -> StateMap:
    """First ``a``, then ``b``."""
    if a.count is None:
        return StateMap(a.head + b.head, b.count, b.tail)
    if b.count is None:
        return StateMap(a.head, a.count, a.tail + b.head)
    return StateMap(a.head, a.count + counter.of(a.tail + b.head) + b.count, b.tail)


def prefix_scan(maps: list[StateMap], counter: Counter) -> list[StateMap]:
    """The composition of each chunk with all before it, in rounds that double the reach."""
    reach = 1
    while reach < len(maps):
        maps = [composed(maps[i - reach], m, counter) if i >= reach else m for i, m in enumerate(maps)]
        reach *= 2
    return maps


def folded(maps: list[StateMap], counter: Counter) -> StateMap:
    """The composition of all maps, neighbours first, so that no prefix is held more than once."""
    while len(maps) > 1:
        maps = [composed(maps[i], maps[i + 1], counter) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def total(maps: list[StateMap], counter: Counter) -> int:
    last = folded(maps, counter)
    return counter.of(last.head) + (last.count or 0) + counter.of(last.tail)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    docs = texts_of(docs, doc_id, text).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def counter() -> Counter:
        return worker_cache(("tokencount", tokenizer), lambda: Counter(tokenizer))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter()
        for batch in batches:
            counts = [own.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc, text, size in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "n_bytes")), strict=True):
                parts = [text[i : i + chunk] for i in range(0, len(text), chunk)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n), pa.array([doc] * n, pa.int64()), pa.array([size] * n), pa.array(range(n), pa.int64()), pa.array(parts)], ["row", "doc_id", "n_bytes", "place", "text"])
                row += 1

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter()
        for batch in batches:
            maps = [state_map(t, own) for t in batch.column("text").to_pylist()]
            arrays = [pa.array([m.head for m in maps], pa.string()), pa.array([m.count for m in maps], pa.int64()), pa.array([m.tail for m in maps], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *arrays], [*batch.schema.names[:4], "head", "count", "tail"])

    def joined(table: pa.Table) -> pa.Table:
        own = counter()
        table = table.sort_by("place")
        maps = [StateMap(*m) for m in zip(*(table.column(c).to_pylist() for c in ("head", "count", "tail")), strict=True)]
        return table.select(["doc_id", "n_bytes"]).slice(0, 1).append_column("n_tokens", pa.array([total(maps, own)], pa.int64()))

    result = "doc_id long, n_bytes long, n_tokens long"
    short = docs.where(F.length("text") <= chunk).mapInArrow(whole, result)
    chunks = docs.where(F.length("text") > chunk).mapInArrow(cut, "row long, doc_id long, n_bytes long, place long, text string")
    maps = chunks.repartition("row", "place").mapInArrow(mapped, "row long, doc_id long, n_bytes long, place long, head string, count long, tail string")
    long = maps.groupBy("row").applyInArrow(joined, result)
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
