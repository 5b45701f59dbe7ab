"""Counts by pre-token against the library's counts of whole texts, over all characters that take that way and some that don't."""

import random

from parcelscope.llm import token_counts

PARTS = ["'s", "'re", "'LL", "''", "<|endoftext|", "<|endoftext|>", "<|StartOfText|>", "  ", "\n\t", "\x0b", "\x1c", "\x85", "\xa0", "İ", "ǅ", "Ⱥ", "Ɐ", "ſ", "é",
         "12", "²", "½", "ª", "_", "__", "a_b", "#!", "-", "\xad", "ß", "ŉ", "ΑΣ", "中文", "don't", "THE", "the quick", "", "\x00", "\x7f", "ﬁ", "'", "!'s"]


def test_counts_by_words_are_the_librarys():
    rng = random.Random(5)
    latin = [chr(c) for c in range(0x250)]
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(2000)]
    texts += ["".join(rng.choices(latin, k=rng.randint(1, 40))) for _ in range(2000)]
    texts += [a + c + b for c in latin for a, b in (("a", "b"), ("1", "."), (" ", "A"))]
    tok = token_counts.tokenizer(token_counts.WORDS)
    want = [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert token_counts._lengths(texts, token_counts.WORDS) == want
    plain = [t for t in texts if token_counts._by_words(t, token_counts.WORDS) is not None]
    assert len(plain) > 1000


def test_a_word_is_encoded_once(monkeypatch):
    seen = []

    class Spy:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return self.tok.encode_batch_fast(texts, **how)
    real = Spy(token_counts.tokenizer(token_counts.WORDS))
    token_counts._kept.cache_clear()
    monkeypatch.setattr(token_counts, "tokenizer", lambda name: real)
    n = token_counts._lengths(["one two two", "Two one", "ONE"] * 50, token_counts.WORDS)
    assert sorted(seen) == ["one", "two"] and n[:3] == [3, 2, 1]


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 3)
    texts = [f"w{c} x{c} yes" for c in "abcdef"]
    tok = token_counts.tokenizer(token_counts.WORDS)
    assert token_counts._lengths(texts, token_counts.WORDS) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    assert len(token_counts._kept(token_counts.WORDS)) <= 3
