"""Token ids of whole texts through bounded caches of chunks and pieces."""

from __future__ import annotations

from array import array

import numpy as np
import regex

from vocalis.llm.shared import cache_of

#: Entries kept per Python worker in either cache; a full cache is emptied.
CACHE_ENTRIES = 250_000
#: Longer chunks are encoded each time.
CACHE_CHARS = 48
#: str.split() parts words at these, the tokenizer's own pattern does not.
_ODD = "\x1c\x1d\x1e\x1f"
#: Below this code point composition changes nothing and lower-casing needs no context.
_PLAIN = "\u0130"

# Fixed value: the piece pattern that the tokenizer file states.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class _Pieces(dict):
    """Ids of a lower-case piece, by the model alone."""

    def __init__(self, model):
        super().__init__()
        self.model, self.symbols = model, byte_symbols()

    def __missing__(self, piece: str) -> bytes:
        line = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.symbols)
        ids = array("I", [t.id for t in self.model.tokenize(line)]).tobytes()
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[piece] = ids
        return ids


class WordEncoder(dict):
    """Little-endian uint32 ids of a text for a lower-casing tokenizer whose pieces never span white space.

    Chunks between white space are looked up; a chunk not seen before is lower-cased and cut into
    pieces, whose ids the tokenizer's model gives. Whatever this could treat otherwise than a direct
    call (characters that compose, special tokens, control characters on which notions of white space
    differ) goes to the tokenizer as a whole, so ids are always those of a direct call.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer.model)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) >= _PLAIN:
            ids = self.whole(chunk)
        elif chunk.isalpha():
            ids = self.pieces[chunk.lower()]
        elif chunk[:-1].isalpha() and not chunk[-1].isalnum():
            ids = self.pieces[chunk[:-1].lower()] + self.pieces[chunk[-1]]
        elif any(s in chunk for s in self.special):
            ids = self.whole(chunk)
        else:
            ids = b"".join(map(self.pieces.__getitem__, _PIECES.findall(chunk.lower())))
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in _ODD):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and tokenizer file."""
    cache_of("encoders", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
