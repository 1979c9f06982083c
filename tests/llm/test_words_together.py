"""New words that reach the library as one text, against the library on whole texts."""

from __future__ import annotations

import numpy as np
import pytest

from barloom.llm import tokens

NAMES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


@pytest.mark.parametrize("kind", NAMES)
def test_words_of_one_text_have_their_own_ids(kind):
    coder = {"byte": tokens.ByteLevelEncoder, "word": tokens.WordEncoder}[kind](tokens.public_vocabulary(NAMES[kind]))
    calls = []
    library = coder.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **more):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **more)

        def __getattr__(self, name):
            return getattr(library, name)

    coder.tokenizer = Counted()
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyzABCÉÈçßäñœŁİıſǅ")
    words = ["".join(rng.choice(letters, int(rng.integers(1, 12)))) for _ in range(3000)]
    odd = ["it's", "WE'LL", "x2y", "日本語", "été", "İ", "a b", "!?", "don't.", "\U0001f600", "ẞ", "ﬁn", "ͅ", "Ω"]
    texts = [" ".join(words[i : i + 300]) for i in range(0, 3000, 300)]
    texts += [" ".join(rng.choice(words + odd * 40, 200)) + end for end in (".", "\n", ",\n\nend") for _ in range(5)]
    texts += odd + ["", " ", "a", " a", "\na b"]
    for t in texts:
        want = np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert coder.encode(t) == want == coder.encode(t)
    assert sum(calls) < 2500  # apart, each of 3,000 new words and more is a text
