import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from scour.llm import pieces, queries

from tests.llm.conftest import FOLDER, ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")
RULES = {"ﬁ": "fi", "①": "1", "ａ": "a", "é": "é", "e": "ë", "​": "", "\t": " ", "\n": " ", "　": " ", "¼": "1⁄4", "é": "E", "eee": "3e"}


def compiled(rules):
    """A double-array trie as the library reads it, placed by first fit."""
    pool, keys, bases = b"", {}, set()
    for k, v in rules.items():
        keys[k.encode()] = len(pool)
        pool += v.encode() + b"\0"
    units, used = [0] * 8192, {0}

    def place(at, prefix):
        below = {k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)}
        labels = below | ({0} if prefix in keys else set())
        base = next(b for b in range(1, 8000) if b not in bases and not any(b ^ x in used for x in labels))
        bases.add(base)
        used.update(base ^ x for x in labels)
        units[at] |= (at ^ base) << 10 | (256 if prefix in keys else 0)
        if prefix in keys:
            units[base] = keys[prefix] | 1 << 31
        for x in below:
            units[base ^ x] = x
        for x in sorted(below):
            place(base ^ x, prefix + bytes([x]))

    place(0, b"")
    data = np.array(units, "<u4").tobytes()
    return len(data).to_bytes(4, "little") + data + pool


def model(tmp_path, rules, prefix=1, trim=1, escape=1, suffix=0, users=()):
    with open(PATH, "rb") as f:
        parts = list(pieces.fields(f.read()))
    spec = pieces._coded(1, b"own") + (pieces._coded(2, compiled(rules)) if rules else b"") + b"".join(pieces._coded(n, v) for n, v in ((3, prefix), (4, trim), (5, escape)))
    data, users = b"", list(users)
    for number, value, raw in parts:
        if number == 3:
            raw = pieces._coded(3, spec)
        elif number == 2:
            raw = pieces._coded(2, value + pieces._coded(24, suffix))
        elif users and b"<unk>" not in raw and b"<s>" not in raw and b"</s>" not in raw and b"<0x" not in raw:
            raw = pieces._coded(1, pieces._coded(1, users.pop().encode()) + pieces._coded(3, 4))
        data += raw
    path = tmp_path / "m.model"
    path.write_bytes(data)
    return str(path)


TEXTS = ["", " ", "  a  b ", "eeee é é eé", "ﬁ①ａ​ x​", "​", "\t\n tab　wide　 ¼ ", "plain words here.", "東京 🙂 ünï", "▁ mark", "<sep>e<sep> é", "a\0b"]


@pytest.mark.parametrize("kind", [dict(rules={}), dict(rules={}, trim=0), dict(rules=RULES), dict(rules=RULES, trim=0), dict(rules=RULES, prefix=0, escape=0), dict(rules=RULES, suffix=1), dict(rules=RULES, users=["<sep>"])])
def test_normalisation_and_ids_equal_library(tmp_path, kind):
    path = model(tmp_path, **kind)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(path)
    assert own.map == {k.encode(): v.encode() for k, v in kind["rules"].items()}
    for text in TEXTS:
        out, source = own.normalised(text.encode())
        want, offsets = library.normalize(text, with_offsets=True)
        assert out.decode() == want, text
        chars = np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
        begins = np.cumsum([0, *(len(c.encode()) for c in want)])
        if want:
            assert [chars.index(source[b]) for b in begins] == offsets, text
        [(ids, starts)] = own.encode([text.encode()])
        assert ids.tolist() == library.encode(text), text
        assert len(starts) == len(ids) + 1 and (np.diff(starts) >= 0).all()


def test_spans_cover_the_text(texts):
    own = pieces.Encoder(PATH)
    for text in [*texts.values(), *TEXTS]:
        data = text.encode()
        [(ids, starts)] = own.encode([data])
        assert b"".join(data[a:b] for a, b in zip(starts, starts[1:])) == data
        for i, a, b in zip(ids.tolist()[:200], starts, starts[1:]):
            if own.sizes[i] > 1:
                assert own.full.id_to_piece(i).replace("▁", " ").strip() == data[a:b].decode().replace("▁", " ").strip()


def test_query(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = queries.QUERIES["op1_pieces"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df, name = pieces.encode_pieces(odd.withColumnRenamed("_id", "pieces"), PATH)
    assert name == "_pieces"
    got = sorted(((r.text or "", np.frombuffer(r[name].ids, "<u4").tolist(), r[name].decoded) for r in df.collect()), key=str)
    assert got == sorted(((t or "", i := library.encode(t or "", add_bos=True, add_eos=True), library.decode(i)) for _, t in ODD), key=str)
    assert pieces.encode_pieces(odd.limit(0), PATH)[0].count() == 0
