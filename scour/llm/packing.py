"""Packing documents into sequences of a fixed number of tokens.

Documents are tokenised and closed with a separator id. One longer than a sequence is cut into full pieces and a
rest. The pieces are dealt at random into groups, and each group is packed on its own by first-fit decreasing:
pieces from long to short, each into the first sequence with room. A tournament tree over the room that is left
in the sequences finds that one in logarithmic time: each inner node holds the most room below it, and the
search goes left whenever the left half has enough.

Tokenising looks up whole words: a worker remembers the ids of the words it has met. Texts with characters
outside ``PLAIN``, where other rules part words, or with special tokens go through the library whole.

Defined results: a null or empty text has the separator alone. Rows with equal or null ids are packed as
separate documents. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from scour.llm.common import give_back, texts_of, worker_cache
from scour.session import cut_lineage

# Letters, digits and white space on which the pattern below and the tokenizer's own surely agree.
LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
PLAIN = re.compile(rf"[\t\n\r -~×÷{LETTERS}]*\Z")
# Fixed value: how byte-level tokenizers of this family part words.
WORDS = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP_PIECES = 4096
KEPT_WORDS = 100_000
BATCH_ROWS = 500
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordIds(dict):
    """Little-endian 32-bit ids of words, by a byte-level tokenizer file."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, vocabulary = _byte_names(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [vocabulary["".join(m)] for m in merges]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.whole = Tokenizer.from_file(path)
        if plain and ids == sorted(ids):  # merges rank as their ids do
            ranks = {bytes(names[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
            self.single = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        else:
            self.single = None

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.single.encode_ordinary(word), "<u4").tobytes()
        if len(word) <= 64 and len(self) < KEPT_WORDS:
            self[word] = found
        return found

    def of(self, text: str) -> bytes:
        if self.single is None or not PLAIN.match(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) < 1_000_000:
            return b"".join(map(self.__getitem__, WORDS.findall(text)))
        words = (m.group() for m in WORDS.finditer(text))
        out = []
        while some := list(islice(words, 100_000)):
            out.append(b"".join(map(self.__getitem__, some)))
        return b"".join(out)


def pieces_of(docs: DataFrame, tokenizer: str, size: int = 2048, separator: int = 1, with_ids: bool = False) -> DataFrame:
    """(uid, doc_id, start, ids_length, ids_crc32, doc_tokens[, ids]): every document cut at multiples of ``size``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words = worker_cache(("packing", tokenizer), lambda: WordIds(tokenizer))
        uid = TaskContext.get().partitionId() << 36
        end = np.array([separator], "<u4").tobytes()
        for batch in (whole.slice(i, BATCH_ROWS) for whole in batches for i in range(0, max(whole.num_rows, 1), BATCH_ROWS)):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.of(text) + end
                for at in range(0, len(ids), 4 * size):
                    piece = ids[at : at + 4 * size]
                    rows.append((uid, doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if with_ids else None))
                    uid += 1
            arrays = [pa.array([r[i] for r in rows], pa.binary() if i == 6 else pa.int64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    found = docs.mapInArrow(run, "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return found if with_ids else found.drop("ids")


class Tournament:
    """The room left in each sequence, with the most room of each half above."""

    def __init__(self, places: int, size: int):
        self.leaves = 1
        while self.leaves < places:
            self.leaves *= 2
        self.room = [size] * (2 * self.leaves)

    def take(self, need: int) -> int:
        """Put ``need`` into the first sequence with as much room."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        place = node - self.leaves
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return place


def first_fit_decreasing(lengths: list[int], size: int) -> list[int]:
    """The sequence of each piece; pieces of equal length keep their order."""
    tree = Tournament(len(lengths), size)
    place = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        place[i] = tree.take(lengths[i])
    return place


def _written(pieces: DataFrame) -> DataFrame:
    """``cut_lineage`` with Arrow batches of at most ``BATCH_ROWS`` whole texts, which both sides hold in memory; the session's setting comes back."""
    conf = pieces.sparkSession.conf
    before = conf.get(ARROW_ROWS)
    conf.set(ARROW_ROWS, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        return cut_lineage(pieces)
    finally:
        conf.set(ARROW_ROWS, before)


def packed(pieces: DataFrame, size: int = 2048, seed: int = 0) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``pieces`` is written first: groups are dealt by the rows' numbers."""
    pieces = _written(pieces)
    groups = pieces.count() // GROUP_PIECES + 1
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("uid", "ascending")])
        lengths = table.column("length").to_numpy()
        place = np.array(first_fit_decreasing(lengths.tolist(), size))
        order = np.lexsort((table.column("uid").to_numpy(), place))
        ends = np.cumsum(lengths[order])
        first = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0])
        base = np.repeat(ends[first] - lengths[order][first], np.diff(np.r_[first, len(order)]))
        group = table.column("group").to_numpy()
        table = table.take(pa.array(order))
        return table.append_column("sequence_id", pa.array((group << 32) + place[order])).append_column("offset", pa.array(ends - lengths[order] - base)).drop_columns(["group", "uid"])

    kept = ", ".join(f"{n} {t}" for n, t in pieces.dtypes if n != "uid")
    return dealt.groupBy("group").applyInArrow(pack, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, separator: int = 1, seed: int = 0, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    return packed(pieces_of(texts_of(docs, doc_id, text), tokenizer, size, separator, with_ids), size, seed)
