"""Repeated passages by sorted suffixes.

A byte goes when it lies in a string of ``match`` bytes that also starts in a document with a smaller id. The
text of a document is its UTF-8; matches stay inside documents and are judged on the input.

1. *Which suffixes.* Of the positions of each window of ``match`` bytes the one whose leading 16 bytes hash
   lowest is its anchor. The choice depends on the window's bytes alone, so equal windows have equal anchors,
   and one suffix in about seventeen speaks for all. Blocks of documents send hashes of their anchors' leading
   bytes to buckets and learn which occur elsewhere; the other suffixes cannot match.
2. *Range partitioning.* Splitters are quantiles of the leading bytes of a bounded sample of suffixes. A block
   sends each of its remaining suffixes, with the bytes of the windows it speaks for, to the bucket between
   whose splitters the leading bytes lie. Equal stretches of a block travel once, with their smallest id.
3. *Local sort.* A bucket sorts all windows by multikey quicksort, eight bytes a key: rows that tie on a key
   are sorted by the next one, the others are settled. Splitters lie between different leading bytes, so equal
   windows never straddle a boundary. The smallest id of equal windows goes back to the blocks.
4. Blocks cover the windows that start in a smaller document and drop the covered bytes.

A passage that a third of all documents share reaches its bucket once for each block, not for each document.

Defined results: null and empty texts and texts shorter than ``match`` keep everything. Rows with equal ids do
not match each other. A null id counts as the largest. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from scour.llm.common import MIX, encoded, fresh, leaves_little, mixed
from scour.session import cut_lineage

GRAM = 16
MATCH = 50
LAST_ID = 2**63 - 1
SAMPLE_SUFFIXES = 100_000
BLOCK_BYTES = 4_000_000
SORT_WINDOWS = 4_000_000


def anchors(text: bytes, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, the first and last window each speaks for, and hashes of their leading bytes."""
    count = len(text) - GRAM + 1
    width = match - GRAM + 1
    if len(text) < match:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    x = words[:count] * MIX[0] + words[8 : 8 + count] * MIX[1]
    x ^= x >> np.uint64(32)
    x *= MIX[2]
    x ^= x >> np.uint64(29)
    # The hash above, the place below: the smallest is the leftmost of the lowest.
    low = x & np.uint64(0xFFFFFFFF00000000) | np.arange(count, dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate((np.zeros(1, np.int64), change))
    last = np.concatenate((change - 1, [len(at) - 1]))
    return at[first], first, last, x[at[first]]


def equal_windows(text: bytes, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, group) of the windows that equal another one, in sorted order. Multikey quicksort, eight bytes a key."""
    words = np.ndarray((max(len(text) - 7, 0),), ">u8", text, 0, (1,))
    index, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for offset in [*range(0, width - 8, 8), width - 8]:
        if not len(index):
            break
        key = words[starts[index] + offset].astype(np.uint64)
        order = np.lexsort((key, group)) if offset else np.argsort(key, kind="stable")
        index, key, group = index[order], key[order], group[order]
        group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]) - 1
        tied = np.bincount(group)[group] > 1
        index, group = index[tied], group[tied]
    return index, group


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays or bytes, each compressed, with their lengths in front."""
    codec = pa.Codec("zstd")
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    packed = [codec.compress(r, asbytes=True) if r else b"" for r in raw]
    return np.array([len(raw), *map(len, raw), *map(len, packed)], np.int64).tobytes() + b"".join(packed)


def _unpack(blob: bytes) -> list[bytes]:
    codec = pa.Codec("zstd")
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, 2 * n, 8)
    out, at = [], 8 * (2 * n + 1)
    for raw, packed in zip(sizes[:n].tolist(), sizes[n:].tolist(), strict=True):
        out.append(codec.decompress(blob[at : at + packed], raw, asbytes=True) if packed else b"")
        at += packed
    return out


class Block:
    """The suffixes of a block of documents."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], match: int):
        self.ids, self.texts, self.match = ids, texts, match
        found = [anchors(t, match) for t in texts]
        self.doc = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        self.at, self.first, self.last, hashes = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(4))
        # Anchors have the lowest hashes of their windows; mixed again they fill all buckets alike.
        self.hashes, self.inverse = np.unique(mixed(hashes.astype(np.uint64)) >> np.uint64(24), return_inverse=True)

    def within(self) -> np.ndarray:
        """Of each hash, whether two documents of the block have it."""
        ids = self.ids[self.doc]
        low, high = np.full(len(self.hashes), LAST_ID), np.full(len(self.hashes), -(2**63))
        np.minimum.at(low, self.inverse, ids)
        np.maximum.at(high, self.inverse, ids)
        return low < high

    def shared(self, seen: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
        """Indices of the suffixes whose leading bytes another document has."""
        cuts = _cuts(self.hashes, buckets)
        mask = self.within()
        for bucket, bits in seen:
            size = cuts[bucket + 1] - cuts[bucket]
            mask[cuts[bucket] : cuts[bucket + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=size).astype(bool)
        return np.flatnonzero(mask[self.inverse])

    def stretches(self, chosen: np.ndarray) -> tuple[dict[tuple[int, bytes], list[int]], list[tuple[int, bytes]]]:
        """Of each (anchor's place, bytes) the smallest and largest id, and the stretch of each suffix chosen."""
        found: dict[tuple[int, bytes], list[int]] = {}
        keys = []
        ids = self.ids.tolist()
        for d, a, s, e in zip(self.doc[chosen].tolist(), self.at[chosen].tolist(), self.first[chosen].tolist(), self.last[chosen].tolist(), strict=True):
            key = (a - s, self.texts[d][s : e + self.match])
            keys.append(key)
            i = ids[d]
            held = found.get(key)
            if held is None:
                found[key] = [i, i]
            elif i < held[0]:
                held[0] = i
            elif i > held[1]:
                held[1] = i
        return found, keys


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the sorted 40-bit hashes begins."""
    edges = np.array([-(-(i << 40) // buckets) for i in range(buckets + 1)], np.uint64)
    return np.searchsorted(hashes, edges)


def _held_twice(lists: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Of each list, which of its values another one has too; a list's values are distinct."""
    every = np.concatenate(lists)
    every.sort()
    twice = every[1:][every[1:] == every[:-1]]
    del every
    for one in lists:
        at = np.searchsorted(twice, one)
        yield at < np.searchsorted(twice, one, side="right")


def _sorted_by_bucket(found: dict[tuple[int, bytes], list[int]], splitters: np.ndarray) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """The stretches in a fixed order and the range bucket of each; the same on every call."""
    keys = sorted(found)
    lead = np.array([text[at : at + GRAM] for at, text in keys], f"S{GRAM}")
    bucket = np.searchsorted(splitters, lead, side="right") if len(keys) else np.empty(0, np.int64)
    order = np.argsort(bucket, kind="stable")
    return [keys[i] for i in order.tolist()], bucket[order]


def _lowest_ids(stretches: list[tuple[int, bytes]], low: np.ndarray, many: np.ndarray, match: int) -> np.ndarray:
    """Runs of windows that two documents have: rows of (stretch, first window, last window, smallest id), by stretch."""
    out = [np.empty((4, 0), np.int64)]
    lead = np.array([text[at : at + GRAM] for at, text in stretches], f"S{GRAM}")
    order = np.argsort(lead, kind="stable")
    sizes = np.array([len(stretches[i][1]) - match + 1 for i in order.tolist()])
    new = np.r_[True, lead[order][1:] != lead[order][:-1]]
    # Whole runs of equal leading bytes, as many at a time as are sorted in bounded memory.
    run = np.cumsum(new) - 1
    load = np.bincount(run, weights=sizes).cumsum() // SORT_WINDOWS
    for rows in np.split(order, np.flatnonzero(np.diff(load[run])) + 1):
        texts = [stretches[i][1] for i in rows.tolist()]
        length = np.array([len(t) for t in texts])
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        count = length - match + 1
        ends = np.cumsum(count)
        owner = np.repeat(np.arange(len(rows)), count)
        starts = begin[owner] + np.arange(ends[-1]) - np.repeat(ends - count, count)
        lowest = np.where(many[rows], low[rows], -1)[owner]
        index, group = equal_windows(b"".join(texts), starts, match)
        if len(index):
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            least = np.minimum.reduceat(low[rows][owner[index]], edges)
            lowest[index] = np.repeat(least, np.diff(np.r_[edges, len(group)]))
        edges = np.flatnonzero(np.concatenate(([True], (lowest[1:] != lowest[:-1]) | (owner[1:] != owner[:-1]))))
        stops = np.append(edges[1:], len(lowest)) - 1
        real = lowest[edges] >= 0
        edges, stops = edges[real], stops[real]
        base = (ends - count)[owner[edges]]
        out.append(np.array([rows[owner[edges]], edges - base, stops - base, lowest[edges]]))
    runs = np.concatenate(out, axis=1)
    return runs[:, np.argsort(runs[0], kind="stable")]


def _to_whole_characters(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The run, and the rest of a character that either of its ends cuts in two."""
    while start > 0 and start < len(text) and text[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(text) and text[end] & 0xC0 == 0x80:
        end += 1
    return start, end


def _block_bytes(total: int) -> int:
    """A worker takes some 40 bytes for each byte of its block, and keeps much of that for the next task."""
    return min(max(BLOCK_BYTES, total // 4096), 4 * BLOCK_BYTES)


def repeated_spans(docs: DataFrame, match: int = MATCH, doc_id: str = "doc_id", text: str = "text", whole_characters: bool = False) -> tuple[DataFrame, str]:
    """All columns and, under a free name that is returned too, a struct: ``starts`` and ``ends`` of the maximal
    removed byte runs, and ``kept``, the bytes that stay; with ``whole_characters`` without those of cut characters."""
    if match < 2 * GRAM:
        raise ValueError(f"match must be at least {2 * GRAM}")
    spark = docs.sparkSession
    order, block, out = (fresh(docs, name) for name in ("order", "block", "repeats"))
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    blocks = int(total // _block_bytes(total)) + 1
    asking = int(total // (8 * BLOCK_BYTES)) + 1
    splitters = _splitters(docs, total, blocks, match, text)
    shared_splitters = spark.sparkContext.broadcast(splitters)  # one a block, of 16 bytes each: 100 MB at 100 TB
    ids = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID))
    dealt = docs.withColumn(order, ids).withColumn(block, F.pmod(F.xxhash64(order, F.octet_length(F.col(f"`{text}`"))), F.lit(blocks)).cast("int"))

    def loaded(table: pa.Table) -> Block:
        texts = [t for chunk in table.column(text).chunks for t in encoded(chunk)]
        return Block(table.column(order).to_numpy(), texts, match)

    def ask(table: pa.Table) -> pa.Table:
        hashes = loaded(table).hashes
        cuts = _cuts(hashes, asking)
        some = [b for b in range(asking) if cuts[b + 1] > cuts[b]]
        rows = [_pack(np.diff(hashes[cuts[b] : cuts[b + 1]], prepend=np.uint64(0))) for b in some]
        return pa.table({"bucket": pa.array(some, pa.int32()), "block": pa.array([table.column(block)[0].as_py()] * len(some), pa.int32()), "payload": pa.array(rows, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(np.frombuffer(_unpack(b)[0], np.uint64)) for b in table.column("payload").to_pylist()]
        bits = [np.packbits(mask).tobytes() for mask in _held_twice(lists)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "sorted": pa.array([False] * len(bits)), "payload": pa.array(bits, pa.binary())})

    reply = "block int, bucket int, sorted boolean, payload binary"
    asked = dealt.groupBy(block).applyInArrow(leaves_little(ask), "bucket int, block int, payload binary")
    seen = cut_lineage(asked.groupBy("bucket").applyInArrow(leaves_little(answer), reply))

    def chosen(table: pa.Table, replies: pa.Table) -> tuple[Block, np.ndarray]:
        held = loaded(table)
        rows = [(b, p) for b, s, p in zip(*(replies.column(c).to_pylist() for c in ("bucket", "sorted", "payload")), strict=True) if not s]
        return held, held.shared(rows, asking)

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        held, some = chosen(table, replies) if table.num_rows else (None, [])
        out_rows: list[tuple[int, bytes]] = []
        if len(some):
            found, _ = held.stretches(some)
            keys, bucket = _sorted_by_bucket(found, shared_splitters.value)
            for rows in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(bucket)) + 1):
                mine = [keys[i] for i in rows.tolist()]
                bounds = np.array([found[k] for k in mine], np.int64)
                out_rows.append((int(bucket[rows[0]]), _pack(
                    np.array([k[0] for k in mine], np.int32), np.array([len(k[1]) for k in mine], np.int32), bounds[:, 0], bounds[:, 0] < bounds[:, 1], b"".join(k[1] for k in mine),
                )))
        home = table.column(block)[0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array([r[0] for r in out_rows], pa.int32()), "block": pa.array([home] * len(out_rows), pa.int32()), "payload": pa.array([r[1] for r in out_rows], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        index: dict[tuple[int, bytes], int] = {}
        low: list[int] = []
        many: list[bool] = []
        places: list[list[int]] = []
        lows: list[np.ndarray] = []
        manys: list[np.ndarray] = []
        for blob in table.column("payload").to_pylist():
            at, length, least, several, text_bytes = _unpack(blob)
            at, length, least, several = np.frombuffer(at, np.int32), np.frombuffer(length, np.int32), np.frombuffer(least, np.int64), np.frombuffer(several, bool)
            ends, mine = np.cumsum(length).tolist(), []
            for a, n, e, i, m in zip(at.tolist(), length.tolist(), ends, least.tolist(), several.tolist(), strict=True):
                k = index.setdefault((a, text_bytes[e - n : e]), len(low))
                if k == len(low):
                    low.append(i)
                    many.append(m)
                else:
                    many[k] = many[k] or m or i != low[k]
                    low[k] = min(low[k], i)
                mine.append(k)
            places.append(mine)
            lows.append(least)
            manys.append(several)
        owner, begin, end, least_id = _lowest_ids(list(index), np.array(low, np.int64), np.array(many), match)
        first = np.searchsorted(owner, np.arange(len(low) + 1))
        rows = []
        for mine, least, several in zip(places, lows, manys, strict=True):
            k = np.array(mine, np.int64)
            count = first[k + 1] - first[k]
            j = np.repeat(np.arange(len(k)), count)
            run = np.arange(len(j)) + np.repeat(first[k] - np.cumsum(count) + count, count)
            # Only documents behind the smallest one lose anything.
            useful = (least_id[run] < least[j]) | several[j] & (least_id[run] == least[j])
            j, run = j[useful], run[useful]
            rows.append(_pack(j, begin[run], end[run], least_id[run]))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "sorted": pa.array([True] * len(rows)), "payload": pa.array(rows, pa.binary())})

    sent = dealt.groupBy(block).cogroup(seen.groupBy("block")).applyInArrow(leaves_little(send), "bucket int, block int, payload binary")
    sorted_runs = sent.groupBy("bucket").applyInArrow(leaves_little(compare), reply)
    result = T.StructType([T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())])
    columns = docs.columns

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({**{c: table.column(c) for c in columns}, out: pa.array([], pa.struct([("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())]))})
        held, some = chosen(table, replies)
        covered = [np.zeros(len(t) + 1, np.int32) if len(t) >= match else None for t in held.texts]
        if len(some):
            found, keys = held.stretches(some)
            order_of, bucket = _sorted_by_bucket(found, shared_splitters.value)
            offset = np.searchsorted(bucket, np.arange(bucket[-1] + 2))
            runs: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            for b, is_sorted, payload in zip(*(replies.column(c).to_pylist() for c in ("bucket", "sorted", "payload")), strict=True):
                if is_sorted:
                    for j, begin, end, least in zip(*(np.frombuffer(x, np.int64).tolist() for x in _unpack(payload)), strict=True):
                        runs.setdefault(order_of[offset[b] + j], []).append((begin, end, least))
            ids = held.ids.tolist()
            for key, d, s in zip(keys, held.doc[some].tolist(), held.first[some].tolist(), strict=True):
                for begin, end, least in runs.get(key, ()):
                    if least < ids[d]:
                        covered[d][s + begin] += 1
                        covered[d][s + end + match] -= 1
        starts, ends, kept = [], [], []
        for t, edges in zip(held.texts, covered, strict=True):
            if edges is None or not edges.any():
                starts.append([])
                ends.append([])
                kept.append(t)
                continue
            gone = np.cumsum(edges) > 0
            change = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
            starts.append(change[::2].tolist())
            ends.append(change[1::2].tolist())
            if whole_characters:
                for b, e in zip(starts[-1], ends[-1], strict=True):
                    b, e = _to_whole_characters(t, b, e)
                    gone[b:e] = True
            kept.append(np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes())
        struct = pa.StructArray.from_arrays([pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["starts", "ends", "kept"])
        return pa.table({**{c: table.column(c) for c in columns}, out: struct})

    done = dealt.groupBy(block).cogroup(seen.unionByName(sorted_runs).groupBy("block")).applyInArrow(leaves_little(remove), T.StructType([*docs.schema.fields, T.StructField(out, result)]))
    return done, out


def _splitters(docs: DataFrame, total: int, buckets: int, match: int, text: str) -> np.ndarray:
    """Quantiles of the leading bytes of a random sample of suffixes, at least four for each bucket."""

    def leads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t[a : a + GRAM] for t in encoded(batch.column(0)) for a in anchors(t, match)[0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["lead"])

    share = max(SAMPLE_SUFFIXES, 4 * buckets) * (match - GRAM) // 2 / max(total, 1)
    sample = docs.select(F.col(f"`{text}`")) if share >= 1 else docs.select(F.col(f"`{text}`")).sample(share, seed=1)
    found = np.sort(np.array(sample.mapInArrow(leads, "lead binary").toArrow().column(0).to_pylist(), f"S{GRAM}"))
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets]) if len(found) else found


def without_repeats(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """The documents without repeated passages, in their columns. What is left of a character that was cut in two goes as well."""
    found, name = repeated_spans(docs, match, whole_characters=True)
    text = F.when(F.size(f"{name}.starts") == 0, F.col("text")).otherwise(F.col(f"{name}.kept").cast("string"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
