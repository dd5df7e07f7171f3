"""SentencePiece encoding that keeps source offsets, and decoding.

Normalisation is done here: at each place the longest prefix that the model's compiled character map knows is
replaced, anything else stays, white space becomes the model's mark, and every normalised byte remembers the
source byte it came from. The library segments the normalised text with a copy of the model that has its own
normalisation taken out. Piece boundaries in the normalised text are then carried back along the alignment, so
each piece has a span of bytes of the original text; spans follow each other without gap or overlap.

The compiled map is a double-array trie of 32-bit units and a pool of replacements that end in zero bytes. It is
walked once when the model is loaded, into a dictionary of all its prefixes.

Defined results: a null or empty text has the begin and end ids alone, and decodes to the empty text. Rows are
encoded one by one. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, types as T

from scour.llm.common import encoded, fresh, worker_cache

MARK = "▁".encode()
# Field numbers of the model file.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
MAP, DUMMY_PREFIX, NO_EXTRA_SPACE, ESCAPE = 2, 3, 4, 5
SUFFIX_SPACE = 24
BYTE_PIECE, USER_PIECE = 6, 4


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, object, bytes]]:
    """(number, value, raw bytes) of the fields of a message; numbers and byte strings only."""
    at = 0
    while at < len(data):
        start = at
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value, data[start:at]


def _coded(number: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """All prefixes of a compiled map and what replaces them."""
    if not blob:
        return {}
    size = int(np.frombuffer(blob, "<u4", 1)[0])
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    pool = blob[4 + size :]

    def child_base(place: int) -> int:
        unit = units[place]
        return place ^ (unit >> 10 << (8 if unit & 512 else 0))

    found: dict[bytes, bytes] = {}
    stack = [(child_base(0), b"")]
    while stack:
        base, prefix = stack.pop()
        for label in range(1, 256):
            place = base ^ label
            if place >= len(units) or units[place] & 0x800000FF != label:
                continue
            text, below = prefix + bytes([label]), child_base(place)
            if units[place] & 256:
                start = units[below] & 0x7FFFFFFF
                found[text] = pool[start : pool.index(b"\0", start)]
            stack.append((below, text))
    return found


class Encoder:
    """A model file, its normalisation and its segmentation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        spec = {number: value for number, value, _ in fields(b"".join(v for n, v, _ in fields(model) if n == NORMALIZER))}
        trainer = {number: value for number, value, _ in fields(b"".join(v for n, v, _ in fields(model) if n == TRAINER))}
        self.prefix, self.trim, self.escape = bool(spec.get(DUMMY_PREFIX, 1)), bool(spec.get(NO_EXTRA_SPACE, 1)), bool(spec.get(ESCAPE, 1))
        self.suffix = bool(trainer.get(SUFFIX_SPACE, 0))
        self.space = MARK if self.escape else b" "
        self.map = character_map(spec.get(MAP, b""))
        pieces = [{n: v for n, v, _ in fields(v)} for n, v, _ in fields(model) if n == PIECE]
        user = [p[1] for p in pieces if p.get(3) == USER_PIECE]
        # User pieces stay as they are. The prefixes that begin with a character, longest first.
        self.known = {k.decode(): v for k, v in [*self.map.items(), *((u, u) for u in user)]}
        self.sizes_from: dict[str, list[int]] = {}
        for k in self.known:
            self.sizes_from.setdefault(k[0], []).append(len(k))
        self.sizes_from = {c: sorted(set(n), reverse=True) for c, n in self.sizes_from.items()}
        self.heads = re.compile("[" + "".join(map(re.escape, self.sizes_from)) + "]") if self.known else None
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=b"".join(
            _coded(NORMALIZER, _coded(1, b"identity") + b"".join(_coded(n, 0) for n in (DUMMY_PREFIX, NO_EXTRA_SPACE, ESCAPE))) if n == NORMALIZER else raw for n, _, raw in fields(model)
        ))
        self.sizes = np.array([1 if p.get(3) == BYTE_PIECE else len(p.get(1, b"")) for p in pieces], np.int64)
        self.full = sentencepiece.SentencePieceProcessor(model_file=path)

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, where the source of that byte begins."""
        out, source = self._replaced(text)
        if self.trim:
            out, source = self._trimmed(out, source, len(text))
        elif not text:
            return b"", np.zeros(1, np.int64)
        if self.trim and not out and not (self.suffix and self._heading(text) < len(text)):
            return b"", source[-1:]
        data = np.frombuffer(out, np.uint8)
        if len(self.space) > 1:
            at = source[:-1]
            wide = np.where(data == 32, len(self.space), 1)
            out, source = out.replace(b" ", self.space), np.append(np.repeat(at, wide), source[-1])
        if self.prefix:
            if self.suffix:
                out, source = out + self.space, np.append(source, np.full(len(self.space), source[-1]))
            else:
                out, source = self.space + out, np.concatenate((np.full(len(self.space), self._heading(text)), source))
        return out, source

    def _longest(self, chars: str, at: int) -> int:
        """The length of the longest known prefix, or 0."""
        return next((n for n in self.sizes_from.get(chars[at], ()) if chars[at : at + n] in self.known), 0)

    def _heading(self, text: bytes) -> int:
        """The bytes of white space in front that trimming drops."""
        chars, at = text.decode() if self.trim else "", 0
        while at < len(chars):
            size = self._longest(chars, at)
            if (self.known[chars[at : at + size]] if size else chars[at].encode()) != b" ":
                break
            at += size or 1
        return len(chars[:at].encode())

    def _replaced(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The longest known prefix at each place replaced."""
        if self.heads is None:
            return text, np.arange(len(text) + 1)
        chars, parts, sources, at, byte = text.decode(), [], [], 0, 0
        found = self.heads.search(chars)
        while found is not None:
            begin = found.start()
            size = self._longest(chars, begin)
            if size:
                before, key = chars[at:begin].encode(), chars[begin : begin + size]
                new, start = self.known[key], byte + len(before)
                parts += [before, new]
                sources += [np.arange(byte, start), np.full(len(new), start)]
                at, byte = begin + size, start + len(key.encode())
            found = self.heads.search(chars, begin + (size or 1))
        return b"".join([*parts, chars[at:].encode()]), np.concatenate([*sources, np.arange(byte, len(text) + 1)])

    @staticmethod
    def _trimmed(out: bytes, source: np.ndarray, end: int) -> tuple[bytes, np.ndarray]:
        """Without spaces at the ends and without repeated ones."""
        data = np.frombuffer(out, np.uint8)
        space = data == 32
        keep = ~(space & np.r_[True, space[:-1]]) if len(data) else np.empty(0, bool)
        if len(data) and keep.any():
            last = np.flatnonzero(~space)
            keep[(last[-1] + 1 if len(last) else 0) :] = False
        kept = np.flatnonzero(keep)
        tail = source[kept[-1] + 1] if len(kept) else end
        return data[kept].tobytes(), np.append(source[kept], tail)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids without begin and end, and where in its bytes each piece begins; the last entry is the end."""
        both = [self.normalised(t) for t in texts]
        every = self.bare.encode([n.decode() for n, _ in both], num_threads=1)
        out = []
        for (text, source), ids in zip(both, every, strict=True):
            ids = np.array(ids, np.int64)
            ends = np.cumsum(self.sizes[ids])
            if len(ids) and ends[-1] != len(text):  # an unknown piece stands for any number of characters
                ends = self._ends(text.decode())
            starts = np.concatenate(([0], ends))
            out.append((ids, np.concatenate((source[starts[:-1]], source[-1:])) if len(ids) else np.zeros(1, np.int64)))
        return out

    def _ends(self, text: str) -> np.ndarray:
        """Where the pieces end, by the library's own account in characters."""
        sizes = np.cumsum([0, *(len(c.encode()) for c in text)])
        return sizes[[end for _, end in self.bare.encode_as_offset_mapping(text)["offsets"]]]


def encode_pieces(df: DataFrame, model: str, text: str = "text", name: str = "pieces") -> tuple[DataFrame, str]:
    """All columns and, under a free name that is returned too, a struct: ``ids`` with the begin and end ids, as
    little-endian unsigned 32-bit integers, ``starts``, the byte of the text at which each inner piece begins and the end of
    the last, as 64-bit integers, ``n`` and ``decoded``, the text that the ids decode to."""
    name = fresh(df, name)
    at = df.columns.index(text)
    inner = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("starts", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(("pieces", model), lambda: Encoder(model))
        bos, eos = encoder.full.bos_id(), encoder.full.eos_id()
        for whole in batches:
            for batch in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                found = encoder.encode(encoded(batch.column(at)))
                ids = [np.concatenate(([bos], i, [eos])) for i, _ in found]
                arrays = [
                    pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array([s.astype("<i8").tobytes() for _, s in found], pa.binary()),
                    pa.array([len(i) for i in ids], pa.int64()), pa.array(encoder.full.decode([i.tolist() for i in ids]), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, inner.names)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, inner)])), name

