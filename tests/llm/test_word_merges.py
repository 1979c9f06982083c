"""New words are encoded by the library's merges alone, with the ids of its whole encoding."""

from __future__ import annotations

import numpy as np
import pytest

from barloom.llm import tokens

NAMES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


@pytest.mark.parametrize("kind", NAMES)
def test_words_take_no_call_of_the_whole_library(kind):
    coder = {"byte": tokens.ByteLevelEncoder, "word": tokens.WordEncoder}[kind](tokens.public_vocabulary(NAMES[kind]))
    library, asked = coder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **how)

    coder.tokenizer = Counted()
    rng = np.random.default_rng(7)
    letters = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and c not in "ªµºİ"]
    words = ["".join(rng.choice(letters, int(rng.integers(1, 9)))) for _ in range(2000)] + letters
    for at in range(0, len(words), 50):
        text = " ".join(words[at : at + 50])
        assert coder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert asked == []
