import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scour.llm import queries, tokencount

from tests.llm.conftest import FOLDER, ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "it's <|endoftext|>x<|startoftext|>", "<|endoftext|><|endoftext|>", "ΑΣ ΣΑΣ İI ﬁ ½ 12 '' !'s don'T 東京 é ä ÿ Ÿ ž", "a\x1cb\x85c\xa0d　e​f", "é ́a", "aaaaaaaaaaaaaaaaaaaaaaa",
    "<|endoftext|", "a" * 3000, "!?" * 2000, "'sss ''re 'LL", " a b", "DŽ ß ẞ ΐ", "नमस्ते दुनिया", "🙂🙂👩‍👩‍👧",
]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_counts_equal_library(counter, library, texts):
    for t in [*texts.values(), *TEXTS, *(t or "" for _, t in ODD)]:
        assert counter.of(t) == size(library, t), t[:200]


def test_random_words(counter, library):
    rng = random.Random(5)
    for alphabet in ("aeinrst", "abcdefghijklmnopqrstuvwxyz", "éèaoßñ", "日本東京語"):
        for _ in range(400):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25)))
            assert counter.transducer.run(word.encode()) == size(library, word), word


def test_reset_keeps_counts(counter, library, monkeypatch):
    monkeypatch.setattr(tokencount, "KEPT_STATES", 3)
    counter.clear()
    assert counter.of("several words that were forgotten again") == size(library, "several words that were forgotten again")


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_maps_compose(counter, library, width):
    for text in TEXTS[:6] + ["some words, don't you  think <|endoftext|> so\n\nor what"]:
        maps = [tokencount.state_map(text[i : i + width], counter) for i in range(0, len(text), width)]
        scanned = tokencount.prefix_scan(maps, counter)
        assert tokencount.total(maps, counter) == tokencount.total([scanned[-1]], counter) == size(library, text)
        for i, m in enumerate(scanned):
            assert tokencount.total([m], counter) == size(library, text[: (i + 1) * width])


def test_texts_without_spaces_are_cut_at_words(counter, library):
    rng = random.Random(8)
    alphabet = ["ab", "Z", "é", "e\u0301", "İ", "Σ", "東京", "。", "，", "7", "½", "'", "'s", "'re", "!", "<", "<|endoftext|>", "<|start", "|>", "\u1100\u1161", "각", "क्", "🙂", "\u0301", "Å", "\u2126"]
    for width in (20, 33, 64, 100):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 200)))
            maps = [tokencount.state_map(text[i : i + width], counter) for i in range(0, len(text), width)]
            assert tokencount.total(maps, counter) == size(library, text), (width, text)
    for text in ("東京都は日本の首都です。" * 3000, "aGVsbG8gd29ybGQ3Kz/" * 3000):
        maps = [tokencount.state_map(text[i : i + 1000], counter) for i in range(0, len(text), 1000)]
        assert all(m.count is not None and len(m.head) + len(m.tail) < 100 for m in maps)
        whole = tokencount.folded(maps, counter)
        assert len(whole.head) + len(whole.tail) < 100 and tokencount.total(maps, counter) == size(library, text)


@pytest.mark.parametrize("chunk", [16, 65_536])
def test_table(spark, library, texts, chunk):
    docs = spark.createDataFrame([*texts.items(), *ODD], "doc_id long, text string")
    got = sorted((tuple(r) for r in tokencount.count_tokens(docs.limit(60 if chunk == 16 else 10**6), PATH, limit=100, chunk=chunk).collect()), key=str)
    rows = [*texts.items(), *ODD][: 60 if chunk == 16 else 10**6]
    assert got == sorted(((i, len((t or "").encode()), n := size(library, t or ""), n > 100) for i, t in rows), key=str)


def test_query(spark, texts):
    assert queries.QUERIES["op2_token_counts"](spark, FOLDER).count() == len(texts)


def test_empty(odd):
    assert tokencount.count_tokens(odd.limit(0), PATH).count() == 0
