"""The batch encoder against the tokenizers library itself."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavekin.llm import token_store, word_encoder


@pytest.fixture(scope="module")
def encoder():
    return word_encoder.WordEncoder(token_store.tokenizer_file())


def same(encoder, texts):
    ids, counts = encoder.encode_batch(texts)
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    ends = np.cumsum(counts)
    got = [ids[end - n : end].tolist() for end, n in zip(ends, counts, strict=True)]
    wrong = [t for t, g, w in zip(texts, got, want, strict=True) if g != w]
    assert not wrong, wrong[:5]


def test_every_character_between_letters_and_marks(encoder):
    assert encoder.plain
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x11000 or c % 97 == 0)]
    for lo in range(0, len(points), 20_000):
        same(encoder, [f"a{chr(c)}.{chr(c)}S '{chr(c)}t" for c in points[lo : lo + 20_000]])


PLAIN = st.text(alphabet="abstmdlrvEéÉßœŒ×÷'’.,;!?-_<|>05 \n\t\r“”…—ªº²½ ́σΣİı\x0b\x1c", max_size=14)
PARTS = st.lists(st.sampled_from(["'", "a", "s", "t", "re", "ve", "ll", "d", "m", " ", ".", "5", "’", "é", "É", "\n", "<|endoftext|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(PLAIN, PARTS, st.text(st.characters(exclude_categories=["Cs"]), max_size=8)), max_size=20))
def test_any_texts(encoder, texts):
    same(encoder, texts)


def test_letters_that_decompose(encoder):
    same(encoder, ["וֹ.", "ढ़.", "aज़.", "שבתוּ.", "<|startoftext|>a", "", "''s 's's ''re 'll'l 'r 've'd'm 'M'D"])


def test_pieces_and_forgetting_change_nothing(encoder, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefé'."), size=int(rng.integers(1, 9)))) for _ in range(4000)]
    texts = [" ".join(words[i : i + 300]) + " " + "日本 " * (i % 3) for i in range(0, 4000, 100)] + ["x" * 5000, None]
    want = encoder.encode_batch(texts, 2)
    monkeypatch.setattr(word_encoder, "PIECE", 1000)
    small = word_encoder.WordEncoder(token_store.tokenizer_file(), memo=100)
    for _ in range(2):
        got = small.encode_batch(texts, 2)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert encoder.encode_batch([])[0].tolist() == []


def test_a_tokenizer_of_another_kind_is_used_as_it_is():
    other = word_encoder.WordEncoder(token_store.tokenizer_file("byte_bpe_50k.json"))
    assert not other.plain
    same(other, ["Hello  World's", "", "Él 12  x\n\ny", "<|endoftext|>"])


def test_streams_are_cut_alike_alone_and_together():
    rng = np.random.default_rng(4)
    streams = [rng.integers(0, 49_000, size=n).astype(np.uint32) for n in (0, 1, 127, 128, 129, 5000, 3, 20_000)]
    together = token_store.cuts(np.concatenate(streams), np.array([len(s) for s in streams]))
    before = 0
    for s, ends in zip(streams, together, strict=True):
        assert [e - before for e in ends] == token_store.cut(s)
        sizes = np.diff([0, *token_store.cut(s)])
        assert sizes.sum() == len(s) and (sizes <= token_store.MOST).all() and (sizes[:-1] > 0).all()
        before += len(s)
