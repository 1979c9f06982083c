"""Exact encoding by the tokenizers library, with the ids of repeated pieces remembered.

Neither vocabulary has a token that spans a blank and what stands before it, so a
text can be cut before blanks and its pieces encoded apart. Pieces repeat a great
deal; each is encoded by the library once while it stays in the table.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import product

import numpy as np

LONGEST = 64

_BLANK_RUNS = re.compile(r"\s{3}|\s{2}\Z|[\x00\x1c-\x1f]")
#: Blanks but space and line feed, and characters that Python and the library do not agree on.
_RARE = "\x00\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: A Latin letter and the ASCII marks, but for the apostrophe, that end a piece.
_MARKED = re.compile(r"(.*[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F])([!-&(-/:-@\[-`{-~]+)", re.S)
#: The parts that a byte-level vocabulary takes a text of Latin letters, ASCII digits, marks and blanks apart into before it merges.
_LATIN = r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F"
_PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_TRIPLES = ["".join(x) for x in product(" \n", repeat=3)]
#: Pieces that are one word of either vocabulary's splitting, whatever stands beside them: a letter whose small form is two characters is left out.
_LETTERS = r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u012F\u0131-\u024F]+"
_SPACED, _PLAIN = re.compile(f" ?{_LETTERS}"), re.compile(_LETTERS)


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(0x100 + k)] = b
    return table


_BYTES = {b: c for c, b in byte_characters().items()}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class PieceEncoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to the library's.

    A worker remembers ``remembered`` pieces, and with ``once`` only such as it met
    twice, for which it keeps up to ``once`` others; a full table is emptied (memory
    only, never results).
    """

    remembered, once = 1_000_000, 0

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.special = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = [t.content for t in self.special]
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """Pieces that can be encoded apart, or None if the text must be encoded whole."""
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.library(text)
        pieces = self.pieces(text)
        if pieces is None:
            return self.library(text)
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            gaps = [i for i, x in enumerate(out) if x is None]
            own, lacking, met = {}, [], self.new
            for p in {pieces[i] for i in gaps}:
                if (x := met.pop(p, None)) is None:
                    lacking.append(p)
                else:
                    own[p] = known[p] = x
            fresh = self.fresh(lacking) if lacking else {}
            own |= fresh
            for i in gaps:
                out[i] = own[pieces[i]]
            if len(known) > self.remembered:
                known.clear()
            if len(met) > self.once:
                met.clear()
            (met if self.once else known).update((p, x) for p, x in fresh.items() if len(p) <= LONGEST)
        return b"".join(out)

    def fresh(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the table lacks."""
        out, rest = {}, []
        for p in new:
            if (ids := self.word(p)) is None:
                rest.append(p)
            else:
                out[p] = ids
        if rest:
            ids = [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            out |= zip(rest, ids)
        return out

    def word(self, piece: str) -> bytes | None:
        """Ids of a piece that is one word, also among others, by the library's merges alone: normalizing and splitting, which cost more, leave it as it is."""
        return None

    def merged(self, word: str) -> bytes:
        """Ids of a word, and of a blank before it, as the vocabulary's splitting gives it."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        elif word[0] == " ":
            word = _BYTES[32] + word[1:]
        return array("I", [t.id for t in self.merge(word)]).tobytes()


class ByteLevelEncoder(PieceEncoder):
    """A byte-level vocabulary whose words take one blank before them.

    A text is cut before each space and line feed. That is exact as long as no
    run of three blanks occurs, nor one of two at the end, as only then would a
    token take blanks from both sides of a cut. No token spans two parts of a new
    piece, such as a word and the marks at its end, so the parts are looked up again.
    """

    def word(self, piece: str) -> bytes | None:
        return self.merged(piece) if _SPACED.fullmatch(piece) else None

    def pieces(self, text: str) -> list[str] | None:
        if any(c in text for c in _RARE):
            if _BLANK_RUNS.search(text):
                return None
        elif any(c in text for c in _TRIPLES) or (len(text) > 1 and text[-2:].isspace()):
            return None
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return cut if cut[0] else cut[1:]

    def fresh(self, new: list[str]) -> dict[str, bytes]:
        known, own, parts, lacking = self.known, {}, {}, set()
        for p in new:
            if (ids := self.word(p)) is not None:
                own[p] = ids
                continue
            found = _PARTS.findall(p)
            if len(found) > 1 and sum(map(len, found)) == len(p):
                parts[p] = found
                lacking.update(q for q in found if q not in known)
            else:
                lacking.add(p)
        lacking.difference_update(own)
        if lacking:
            own |= super().fresh(list(lacking))
        for p, found in parts.items():
            own[p] = b"".join([own[q] if q in own else known[q] for q in found])
        return own


class WordEncoder(PieceEncoder):
    """A vocabulary with word ends, which drops blanks: a text is cut at each space and line feed.

    Its words are runs of letters in lower case, and marks stand apart from them, so
    a new piece is looked up again without its case and the marks at its end. Its
    table is small, as workers of the pipeline hold those of other stages too.
    """

    remembered, once = 400_000, 300_000

    def word(self, piece: str) -> bytes | None:
        if not _PLAIN.fullmatch(piece):
            return None
        low = piece.lower()
        if low != piece and (ids := self.known.get(low)) is not None:
            return ids
        return self.merged(low)

    def pieces(self, text: str) -> list[str] | None:
        return [p for p in text.replace("\n", " ").split(" ") if p]

    def fresh(self, new: list[str]) -> dict[str, bytes]:
        known, own, parts = self.known, {"": b""}, {}
        for p in new:
            if (ids := self.word(p)) is not None:
                own[p] = ids
                continue
            m = _MARKED.fullmatch(p)
            stem, marks = m.groups() if m else (p, "")
            parts[p] = (stem.lower() if stem.isascii() and stem.isalpha() else stem, marks)
        if lacking := {q for pair in parts.values() for q in pair if q not in known and q not in own}:
            own |= super().fresh(list(lacking))
        for p, pair in parts.items():
            stem, marks = (own[q] if q in own else known[q] for q in pair)
            own[p] = stem + marks
        return own


_LOADED: dict[tuple[str, str], PieceEncoder] = {}


def encoder(kind: str, path: str) -> PieceEncoder:
    """The worker's encoder of a vocabulary file; kind is byte or word."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = {"byte": ByteLevelEncoder, "word": WordEncoder}[kind](path)
    return _LOADED[kind, path]


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
