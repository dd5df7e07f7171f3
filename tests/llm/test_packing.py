import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scour.llm import packing

from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["it's  I'LL\n\n x", "a<|endoftext|>b", "tab\t\tnew\r\nline \x0bv", "naïve 3.14×2 ½ ²", "東京🙂 ok", "  ", " a b", "ʼʯʰ ƀ", "x" * 5000, "ab " * 3000]


def test_ids_equal_library(texts):
    words, library = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    assert words.single is not None
    for t in [*texts.values(), *TEXTS, *(t or "" for _, t in ODD)]:
        assert np.frombuffer(words.of(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_long_texts_in_parts(monkeypatch):
    words = packing.WordIds(PATH)
    text = "many words, 12 of them, again. " * 40_000
    assert words.of(text) == words.of("many words, 12 of them, again.") + words.of(" many words, 12 of them, again.") * 39_999 + words.of(" ")


def check(rows, wanted, size):
    library = Tokenizer.from_file(PATH)
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc, want in wanted.items():
        ids = library.encode(want, add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return sum(r.length for r in rows) / (size * len(sequences))


@pytest.mark.parametrize("size,pieces", [(2048, 4096), (64, 50)])
def test_table(documents, texts, monkeypatch, size, pieces):
    monkeypatch.setattr(packing, "GROUP_PIECES", pieces)
    fill = check(packing.pack_documents(documents, PATH, size).collect(), texts, size)
    print(size, fill)
    assert fill > 0.97


def test_odd_rows(odd):
    once = {i: t or "" for i, t in ODD if i != 4}
    check(packing.pack_documents(odd.where("doc_id <> 4 OR doc_id IS NULL"), PATH).collect(), once, 2048)
    assert packing.pack_documents(odd.where("doc_id = 4"), PATH).count() == 2
    assert packing.pack_documents(odd.limit(0), PATH).count() == 0


def test_ids_come_along(odd):
    for r in packing.pack_documents(odd, PATH, 100, with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_tournament_is_first_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 500).tolist()
    room, want = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        room[k] -= lengths[i]
        want[i] = k
    assert packing.first_fit_decreasing(lengths, 100) == want
