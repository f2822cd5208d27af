import hashlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphmill.llm.bpe_tree import FAR, Encoder, encode_decode, leaf_ends

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    return Encoder(PATH)


def want(tok, text):
    ids = tok.encode(text, add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))


def test_shortcut_on_every_character(tok, enc):
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF or (c > 0x2FFF and c % 997):
            continue
        text = f"Ab{chr(c)}c {chr(c)}1'{chr(c)}s"
        assert enc.digests(text) == want(tok, text), hex(c)


def test_each_token_merges_to_itself(tok, enc):
    """What makes merging by rank equal to merging by pairs."""
    from glyphmill.llm.bpe_tree import word_ranks

    vocab = {k: v for k, v in tok.get_vocab(with_added_tokens=False).items() if k not in enc.tree.special}
    for token, i in vocab.items():
        if token.endswith("</w>") and token != "</w>":
            assert [t.id for t in tok.model.tokenize(token.removesuffix("</w>"))] == [i]
    for raw, i in word_ranks(vocab, enc.tree.special).items():
        if raw.endswith(b"\xff") and len(raw) > 1:
            assert enc.words.piece(raw) == [i]


def test_shortcut_on_random_texts(tok, enc):
    rng = random.Random(5)
    pieces = ["the", "'s", "'", "RE", "'ll", "é", "É", "ß", "İ", "Σ", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "1", "23", "###", "|", "!!", "<|endoftext|>", "<|", "é", "ä", "日本", "😀", "_", "½", "²"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert enc.digests(text) == want(tok, text), repr(text)


@pytest.mark.parametrize("alphabet", ["ab'", "the and of 's re!! ", "aé́ñ ", "x", "!?'#s", "12 a", "日本 a", "Σσ İi "])
@pytest.mark.parametrize("leaf", [3, 17, 64])
def test_tree_equals_whole(tok, enc, alphabet, leaf):
    rng = random.Random(leaf)
    for n in (0, 1, leaf, leaf + 1, 500, 1500):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert enc.tree.encode(text, leaf) == tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("alphabet", ["ab ", "the and of 's re!! ", "aé ñ ", "x", " \n\t", "12 a ", "Σσ d "])
@pytest.mark.parametrize("leaf", [3, 17, 64])
def test_tree_of_words_equals_whole(tok, enc, alphabet, leaf):
    rng = random.Random(leaf)
    for n in (0, 1, leaf, leaf + 1, 500, 1500):
        for _ in range(5):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert enc.digests(text, leaf) == want(tok, text), repr(text)


def test_long_word_joins_in_windows(tok, enc):
    rng = random.Random(9)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    seen = []
    leaf = enc.tree.leaf
    enc.tree.leaf = lambda t, at=0: seen.append(len(t)) or leaf(t, at)
    try:
        assert enc.tree.encode(text, 4096) == tok.encode(text, add_special_tokens=False).ids
    finally:
        enc.tree.leaf = leaf
    assert max(seen) <= 4096


def test_leaf_ends_cover():
    assert leaf_ends("") == []
    assert leaf_ends("a" * 10, 3)[-1] == 10
    assert leaf_ends("é" * 10, 3) == [20]


def test_encode_decode(spark, tok):
    rng = random.Random(1)
    long = " ".join(rng.choice(["the", "And", "of,", "x" * 50, "élan's", "12%"]) for _ in range(9000))
    assert len(long) > FAR
    rows = [(1, "Hello  World's é"), (2, None), (3, ""), (4, long), (4, long), (None, "a"), (5, "y" * (FAR + 5)), (6, long + "<|endoftext|>")]
    df = spark.createDataFrame([(a, b, "n") for a, b in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, encode_decode(df, PATH).collect()), key=str)
    assert got == sorted([(i, *want(tok, t or "")) for i, t in rows], key=str)
    assert encode_decode(df.limit(0), PATH).count() == 0
