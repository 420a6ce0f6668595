"""Words of whole batches of texts as flat arrays: no Python object per word.

A word is what is left of a run between white space when lower-cased and rid of everything but letters
and digits, so case, punctuation, spacing and line breaks don't matter. Soft hyphens and zero-width
characters vanish; a hyphen before a line break joins the halves of the word. Runs without a letter or
digit are no words, except blacked-out ones (blocks or an ellipsis), which are kept as marks.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_SKIP, _SPACE, _LETTER, _BLACK = 0, 1, 2, 3
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

_ASCII = np.full(256, _SKIP, np.uint8)
for _c in b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f":
    _ASCII[_c] = _SPACE
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _ASCII[_c] = _LETTER
_ASCII[0x80:] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: letters that scanning takes for one another, as one form
_FORM = np.arange(256, dtype=np.uint8)
for _a, _b in (b"1l", b"il", b"0o", b"5s"):
    _FORM[_a] = _b
_LENGTH = np.uint64(0x9E3779B97F4A7C15)

#: ligatures that scanning leaves behind, as bytes
_LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
BLACK_HASH = np.uint64(1)


@dataclass
class Words:
    hash: np.ndarray  # uint64, one per word; BLACK_HASH for a blacked-out one
    doc: np.ndarray  # int32, index of the text
    start: np.ndarray  # int64, first byte in ``buffer``
    end: np.ndarray  # int64
    buffer: bytes
    first: np.ndarray  # int64, index of the first word of each text, and the number of words at the end
    upper: np.ndarray  # bool, whether the word begins with a capital letter
    closing: np.ndarray  # bool, whether the run ends with a full stop, question or exclamation mark
    low: np.ndarray  # uint8, the buffer in lower case
    letters: np.ndarray  # int64, places of letters and digits in ``buffer``
    spell: np.ndarray  # int64, where in ``letters`` each word begins
    size: np.ndarray  # int64, and how many letters it has

    def text(self, i: int) -> str:
        """The word itself, normalised; '█' for a blacked-out one."""
        if self.hash[i] == BLACK_HASH:
            return "█"
        return normal(self.buffer[self.start[i] : self.end[i]].decode("utf-8", "ignore"))

    def shapes(self) -> "Shapes":
        return Shapes(self)


class Shapes:
    """Keys of words as scanning sees them, letters of one shape being one: a word's own, and those of it less one letter.

    Two words that differ by one letter more, less, other or swapped with its neighbour share a key.
    """

    SLIP_LETTERS = 5  # shorter words are compared as they are

    def __init__(self, ws: Words) -> None:
        low = ws.low[ws.letters]
        unit = low < 0xC0  # the lead bytes of longer letters don't count, so that a letter is one place
        count = np.concatenate([[0], np.cumsum(unit, dtype=np.int64)])
        self.begin = count[ws.spell]
        self.size = count[ws.spell + ws.size] - self.begin
        self.owner = np.repeat(np.arange(len(self.begin)), self.size)
        place = (np.arange(len(self.owner)) - self.begin[self.owner]).astype(np.uint8)
        zero = np.zeros(1, np.uint64)
        with np.errstate(over="ignore"):
            value = _VALUE[_FORM[low[unit]]]
            self.here = np.concatenate([zero, np.cumsum(value * _POWER[place], dtype=np.uint64)])
            self.back = np.concatenate([zero, np.cumsum(value * _POWER[place - np.uint8(1)], dtype=np.uint64)])
            self.own = _mix(self.here[self.begin + self.size] - self.here[self.begin] + self.size.astype(np.uint64) * _LENGTH) | np.uint64(2)
        self.own[ws.hash == BLACK_HASH] = BLACK_HASH

    def less(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, key) of each letter taken out of the words marked in ``among`` that are long enough to be read with a slip."""
        at = np.flatnonzero((among & (self.size >= self.SLIP_LETTERS))[self.owner])
        w = self.owner[at]
        first = self.begin[w]
        with np.errstate(over="ignore"):
            parts = self.here[at] - self.here[first] + self.back[first + self.size[w]] - self.back[at + 1]
            return w, _mix(parts + (self.size[w] - 1).astype(np.uint64) * _LENGTH) | np.uint64(2)


_NOT_WORD = re.compile(r"[\W_]+")


def normal(run: str) -> str:
    return _NOT_WORD.sub("", run.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def words(texts: list[str | None]) -> Words:
    encoded = []
    for t in texts:
        t = t or ""
        for a, b in _LIGATURES:
            if a in t:
                t = t.replace(a, b)
        if "-\n" in t:
            t = re.sub(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[a-zà-ÿ])", "", t)
        encoded.append(t.encode("utf-8", "ignore"))
    buffer = b"\n".join([*encoded, b""])
    lengths = np.array([len(e) + 1 for e in encoded], np.int64)
    ends = np.cumsum(lengths)
    raw = np.frombuffer(buffer, np.uint8)
    kind, low = _ASCII[raw], _LOWER[raw]
    high = np.flatnonzero(raw >= 0xC2)
    if len(high):
        low = low.copy()
        lead, nxt = raw[high], raw[np.minimum(high + 1, len(raw) - 1)]
        third = raw[np.minimum(high + 2, len(raw) - 1)]
        latin = high[(lead == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)]
        low[latin + 1] += 0x20
        signs = high[lead == 0xC2]
        for k in (0, 1):
            kind[signs + k] = _SKIP
        nbsp = high[(lead == 0xC2) & (nxt == 0xA0)]
        kind[nbsp] = _SPACE
        wide = (lead == 0xE2) | (lead == 0xEF)
        for k in (0, 1, 2):
            kind[high[wide] + k] = _SKIP
        thin = (lead == 0xE2) & (nxt == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
        kind[high[thin]] = _SPACE
        black = ((lead == 0xE2) & (nxt == 0x96)) | ((lead == 0xE2) & (nxt == 0x80) & (third == 0xA6))
        kind[high[black]] = _BLACK
    space = kind == _SPACE
    # runs between white space
    inside = ~space
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    if len(end) < len(begin):
        end = np.append(end, len(raw))
    empty = np.empty(0, np.int64)
    if not len(begin):
        return Words(np.empty(0, np.uint64), np.empty(0, np.int32), empty, empty, buffer, np.zeros(len(texts) + 1, np.int64), np.empty(0, bool), np.empty(0, bool), low, empty, empty, empty)
    letters = np.flatnonzero(kind == _LETTER)
    n_letters = np.concatenate([[0], np.cumsum(kind == _LETTER, dtype=np.int64)])
    per = n_letters[end] - n_letters[begin]
    marks = np.concatenate([[0], np.cumsum(kind == _BLACK, dtype=np.int64)])
    blacked = (marks[end] - marks[begin] > 0) & (per == 0)
    offset = np.arange(len(letters)) - np.repeat(n_letters[begin], per)
    with np.errstate(over="ignore"):
        part = _VALUE[low[letters]] * _POWER[offset & 255]
    total = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        hashes = _mix(total[n_letters[end]] - total[n_letters[begin]] + per.astype(np.uint64)) | np.uint64(2)
    hashes[blacked] = BLACK_HASH
    keep = (per > 0) | blacked
    spell, per = n_letters[begin[keep]], per[keep]
    begin, end, hashes = begin[keep], end[keep], hashes[keep]
    doc = np.searchsorted(ends, begin, side="right").astype(np.int32)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    initial = letters[np.minimum(n_letters[begin], max(0, len(letters) - 1))] if len(letters) else begin
    lead, nxt = raw[initial], raw[np.minimum(initial + 1, len(raw) - 1)]
    upper = ((lead >= 0x41) & (lead <= 0x5A)) | ((lead == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E))
    last = raw[end - 1]
    closing = (last == 0x2E) | (last == 0x3F) | (last == 0x21)
    return Words(hashes, doc, begin, end, buffer, first, upper, closing, low, letters, spell, per)


def slices(texts: list[str | None], rows: int = 256, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, length) of runs of texts of at most ``rows`` texts and, unless one text alone is longer, ``chars`` letters."""
    first = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and (i - first >= rows or total + n > chars):
            yield first, i - first
            first, total = i, 0
        total += n
    if len(texts) > first:
        yield first, len(texts) - first
