"""Bounded caches for what is computed once per distinct pre-token."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import public_tokenizers
import regex

#: Entries in either half of a cache of text parts; of pre-tokens, a third as many.
PARTS = 450_000
#: Longer pre-tokens aren't kept.
CACHE_CHARS = 64
#: Characters of the texts whose unknown parts are computed together.
GROUP_CHARS = 400_000


class TwoHalves:
    """A mapping that drops the half of its entries that went unused longest. fill(keys) gives values."""

    def __init__(self, fill, size: int):
        self.fill, self.size, self.new, self.old = fill, size, {}, {}

    def of(self, keys: list) -> list:
        """The values of the keys, in order."""
        new, old = self.new, self.old
        missing = set(keys).difference(new)
        if not missing:
            return list(map(new.__getitem__, keys))
        ask = []
        for k in missing:
            v = old.get(k)
            if v is None:
                ask.append(k)
            else:
                new[k] = v
        long = []
        for k, v in zip(ask, self.fill(ask) if ask else ()):
            new[k] = v
            if len(k) > CACHE_CHARS:
                long.append(k)
        values = list(map(new.__getitem__, keys))
        for k in long:
            del new[k]
        if len(new) > self.size:
            self.new, self.old = {}, new
        return values


#: White space other than the plain space and the line feed; fixed values.
OTHER_SPACE = "\t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NEAR_SPACE = ("  ", " \n", "\n ")


def spaced_parts(text: str) -> list[str] | None:
    """text cut at its single spaces, or None if a pre-token might reach over such a cut.

    A space between two characters that aren't white space always begins a
    pre-token, so the parts (each after the first with its space) can be split
    and encoded one by one.
    """
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in NEAR_SPACE):
        return None
    if any(x in text for x in (OTHER_SPACE[:4] if text.isascii() else OTHER_SPACE)):
        return None
    return text.split(" ")


class PartCache:
    """Results by text part, from results by pre-token.

    fill(pre-tokens) gives values, joined(values) the value of a part of several.
    """

    def __init__(self, split, fill, joined, size: int = PARTS):
        self.split, self.fill, self.joined = split, fill, joined
        self.pieces = TwoHalves(fill, size // 3)
        self.parts = TwoHalves(self._fill, size)

    def _fill(self, parts: list[str]) -> list:
        whole = [p.isascii() and p.isalpha() for p in parts]  # one pre-token with its space
        cut = [self.split(" " + p) for p, w in zip(parts, whole) if not w]
        plain = iter(self.fill([" " + p for p, w in zip(parts, whole) if w]))
        values, out, at, n = self.pieces.of([x for c in cut for x in c]), [], 0, 0
        for w in whole:
            if w:
                out.append(next(plain))
                continue
            end = at + len(cut[n])
            out.append(self.joined(values[at:end]))
            at, n = end, n + 1
        return out

    def of_all(self, texts: list[str]) -> Iterator[list]:
        """A list of values for each text, in order. What is unknown in all of them is filled at once."""
        pieces, parts, cut = [], [], []
        for text in texts:
            spaced = spaced_parts(text)
            first = self.split(text if spaced is None else spaced[0])
            rest = spaced[1:] if spaced else []
            cut.append((len(first), len(rest)))
            pieces += first
            parts += rest
        pieces, parts, a, b = self.pieces.of(pieces), self.parts.of(parts), 0, 0
        for n, m in cut:
            yield pieces[a : a + n] + parts[b : b + m]
            a, b = a + n, b + m


def grouped(texts: Iterable[str], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """texts in groups of about that many characters, or one longer text."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text) > chars:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def splitter(pattern: str = public_tokenizers.PATTERN):
    return regex.compile(pattern).findall


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def byte_alphabet() -> dict[str, int]:
    """Byte of each letter that byte-level vocabularies write for it: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
