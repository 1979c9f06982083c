"""Parts of new pieces, looked up again: the library's ids, with fewer calls of it."""

from __future__ import annotations

import random

from barloom.llm.tokens import ByteLevelEncoder, public_vocabulary


def test_parts_give_the_librarys_ids():
    encode = ByteLevelEncoder(public_vocabulary("byte_bpe_50k.json"))
    rng = random.Random(6)
    marks = list("abzAZ019'.,!?-_(){}[]|~`@#$%&*;:/\\\"<>=+^") + [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　"]
    others = ["ä", "É", "×", "÷", "ª", "ǅ", "ɏ", "ɐ", "ø", "é", "Ω", "日", "٣", "²", "½", "😀", "'s", "'re", "'LL", "don't", "it's,", "'ve."]
    for n in range(6000):
        text = "".join(rng.choice(marks + others) for _ in range(rng.randint(1, 14)))
        assert encode.encode(text) == encode.library(text), repr(text)


def test_a_known_word_with_marks_is_no_new_call():
    encode = ByteLevelEncoder(public_vocabulary("byte_bpe_50k.json"))
    asked = []
    batch = encode.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return batch(texts, **how)

    first = encode.encode("the word , the ünder .")
    encode.tokenizer = Counted()
    assert first and encode.encode("the word, the ünder.") and sorted(asked) == [",", "."]
    asked.clear()
    encode.encode("the word., word, ünder, the.")
    assert asked == [".,"]
