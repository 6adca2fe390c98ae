"""Token ids of whole texts by the ``tokenizers`` library, with a bounded word cache.

Byte-level BPE works on pre-tokens that never span the start of a word, so a text in which
every white-space character stands alone is the concatenation of its words' ids.  Words are
encoded by the library once and looked up afterwards; any other text (runs of white space, the
literal of a special token) is encoded whole.  Both give the ids of ``encode(text)``.
"""

from __future__ import annotations

import array
import functools
import os
from collections.abc import Iterator

import numpy as np

MARKS = frozenset(".,")
#: The public byte-level alphabet: printable bytes stand for themselves, the others follow at 256.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPACE = "\u0120"  # its letter for a space
LETTERS = {b: b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b)) for b in range(256)}


def plain(word: str) -> bool:
    """Whether a word is letters only, all of them in blocks that no library's tables differ on."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, keep: int = 500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line = self.whole("\n")
        #: The cache relies on a line feed being one pre-token of one id; else all texts go whole.
        self.words = Words(self, int(np.frombuffer(line, "<u4")[0]), keep) if len(line) == 4 and self._splits() else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _splits(self) -> bool:
        """Whether this tokenizer treats words apart, as byte-level BPE without prefix space does."""
        probe = "One two,\nthree. 4th caf\u00e9"
        parts = ("One", " two", ",", "\n", "three", ".", " 4", "th", " caf\u00e9")
        return self.whole(probe) == b"".join(map(self.whole, parts)) and all(self.letters(x) == self.whole(x) for x in ("One", " two", " caf\u00e9"))

    def letters(self, token: str) -> bytes:
        """The ids of one pre-token, from the library's model alone."""
        return array.array("I", [t.id for t in self.tokenizer.model.tokenize(token.encode().decode("latin-1").translate(LETTERS))]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.words is None:
            return [self.whole(t) for t in texts]
        get, out = self.words.__getitem__, []
        for t in texts:
            flat = t.replace("\n", " ")
            if t and " ".join(t.split()) == flat and not any(s in t for s in self.special):
                out.append(b"".join(map(get, ("\n" + (flat if "\n" not in t else t.replace("\n", " \n"))).split(" ")))[4:])
            else:
                out.append(self.whole(t))
        return out


class Words(dict):
    """The ids of words, each with the space or the line feed before it, learned as they come.

    The last ``keep`` words are held, and as many from before them."""

    def __init__(self, encoder: Encoder, line: int, keep: int) -> None:
        self.encoder, self.line, self.keep = encoder, line, keep
        self.tokenize, self.old, self.lines = encoder.tokenizer.model.tokenize, {}, array.array("I", [line]).tobytes()
        self.marks = {m: encoder.whole(m) for m in MARKS}

    def __missing__(self, w: str) -> bytes:
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()
        if (ids := self.old.get(w)) is None:
            if w[-1] in MARKS and plain(w[-2:-1]):  # a letter, then one mark: two pre-tokens
                ids = self[w[:-1]] + self.marks[w[-1]]
            else:
                body = w[1:] if (first := w[0] == "\n") else w
                if body.isascii() and body.isalpha():
                    found = [t.id for t in self.tokenize(body if first else SPACE + body)]
                    ids = array.array("I", [self.line, *found] if first else found).tobytes()
                else:
                    part = body if first else " " + body
                    ids = self.encoder.letters(part) if plain(body) else self.encoder.whole(part)
                    if first:
                        ids = self.lines + ids
        self[w] = ids
        return ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def chunks(texts: list[str], most: int = 2_000_000, rows: int = 512) -> Iterator[tuple[int, list[str]]]:
    """Consecutive slices of about ``most`` characters with the index of their first text."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most or k - at + 1 >= rows:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]
