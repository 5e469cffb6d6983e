"""Token ids of whole texts by a public tokenizer, with a bounded cache in each Python worker."""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers
import regex

#: Pieces that each of the cache's two generations may hold.
CACHE = 400_000
#: Longer pieces are encoded each time and never kept.
LONGEST = 64

# White space, and the Latin-1 characters of the classes L and N, as Unicode has them.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER_1 = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER_1 = "0-9²³¹¼½¾"
_SPACE_1 = r"\t-\r \x85\xa0"


def _pieces(library, letter: str, number: str, space: str):
    """The vocabulary's published pre-tokenization for the given character classes."""
    return library.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


_ANY = _pieces(regex, r"\p{L}", r"\p{N}", _SPACE)
_LATIN_1 = _pieces(re, _LETTER_1, _NUMBER_1, _SPACE_1)


class Encoder:
    """Ids of ``tokenizers`` for a byte-level vocabulary, as little-endian unsigned 32-bit bytes.

    The vocabulary never merges over the bounds of its pre-tokenization, so a text is cut there and each different piece is
    encoded by the library once. ``encoded`` finds the added tokens in a text as the library does by default; to ``ids`` their
    strings are ordinary text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        if not isinstance(tokenizer.pre_tokenizer, ByteLevel) or tokenizer.normalizer is not None:
            raise ValueError("the vocabulary must be byte-level and without a normalizer")
        self._model = tokenizer.model
        self._tokenizer = tokenizer
        added = tokenizer.get_added_tokens_decoder()
        self._added = {token.content: np.array([number], "<u4").tobytes() for number, token in added.items()}
        # White space beside some tokens is theirs, and some are whole words only: the library must see such texts whole.
        self._plain = not any(token.lstrip or token.rstrip or token.single_word for token in added.values())
        longest_first = sorted(self._added, key=len, reverse=True)
        self._bounds = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self._letters = _byte_letters()
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def encoded(self, text: str | None) -> bytes:
        """Ids as ``Tokenizer.encode`` gives them with ``add_special_tokens=False``. Null and empty texts have none."""
        if not text or self._bounds is None or not self._bounds.search(text):
            return self.ids(text)
        if not self._plain:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self._added[part] if at % 2 else self.ids(part) for at, part in enumerate(self._bounds.split(text)))

    def ids(self, text: str | None) -> bytes:
        """Null and empty texts have no ids."""
        if not text:
            return b""
        try:
            text.encode("latin-1")
            pieces = _LATIN_1.findall(text)
        except UnicodeEncodeError:
            pieces = _ANY.findall(text)
        found = list(map(self._young.get, pieces))
        if None in found:
            found = [self._piece(piece) if known is None else known for piece, known in zip(pieces, found)]
        return b"".join(found)

    def _piece(self, piece: str) -> bytes:
        known = self._young.get(piece) or self._old.get(piece)
        if known is None:
            spelled = piece.encode().decode("latin-1").translate(self._letters)
            known = np.array([token.id for token in self._model.tokenize(spelled)], "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self._young) >= CACHE:
                self._old, self._young = self._young, {}
            self._young[piece] = known
        return known


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in set(printable)]
    return {byte: chr(byte) for byte in printable} | {byte: chr(256 + at) for at, byte in enumerate(others)}


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a vocabulary file: a name among the public tokenizers, or an absolute path."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))
    return _encoders[vocabulary]
