"""Held-out test passages inside long documents.

Test items are short and documents long, so whole documents can't be compared with whole items: their
MinHash values would be those of the document's other words. Both are therefore cut into windows of
equal length, which puts every compared pair into one size class, where containment and similarity are
the same thing. Items are partitioned by length: those of twelve words and more by windows of six words,
of which one may differ, shorter ones by two words that stand next to each other or next but one. Each
class has its own index of banded MinHash signatures.

Words are compared by the forms they may be read in (see ``Slips``), so a slip in a single letter of a
longer word doesn't change a window at all; the windows have to bear only slips in short words, and
split or joined words. Every item with a window that agrees is verified against the whole text: by exact
containment of its shingles of five words, which is reported, and, since a shingle with a slip isn't
contained, word by word in both directions from the window, over single-letter slips, split and joined
words, page headers and paragraph numbers.

The items are a stated query set. They are dealt into blocks of a bounded number of words, each of which
is indexed once, sent to the workers as a broadcast and held against all documents. Documents are only
read, never shuffled or gathered.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.words import BLACK_HASH, Words, _mix, normal, slices, words
from ledgerweave.storage import store

BLOCK_CHARS = 4 << 20  # of items in one block; its index takes about forty times as many bytes
RUN = 12  # successive words that make a leak
SHINGLE = 5
BANDS, ROWS = 4, 2
MAX_HEADER = 16
MAX_BLACK = 12
ASKING = 8  # words of a question or request, at most
_SEEDS = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_HEADER_WORDS = {"page", "p", "pp", "seite", "s", "rn", "rdn", "no", "nr", "para", "abs", "blatt", "sheet", "fol"}
_CASE = r"(\d+)[\s.-]*([^\W\d_]{1,4})[\s.-]*(\d+)\s*/\s*(\d+)"
_HEADING = re.compile(rf"\W*((?:[^\W\d_]+[^\w\n]+){{1,8}}?){_CASE}")
_PAGE = re.compile(rf"\b(?:page|pp?|seite|s|blatt|sheet|fol)\b[.\s]*\d{{1,4}}\b\W*((?:[^\W\d_]+\W+){{0,8}}?){_CASE}", re.IGNORECASE)
_SAME = str.maketrans({"1": "l", "0": "o", "5": "s", "i": "l"})


def readings(text: str) -> list[tuple[int, int]]:
    """(first word, end) of everything that may be the passage of an item.

    A first or last sentence that ends with a question mark, or is short and without a number, may be a
    question or request; the item is looked for with and without it, unless it is longer than the rest.
    """
    parts = [p for p in re.split(r"(?<=[.?!])\s+", (text or "").strip()) if re.search(r"\w", p)]
    sizes = np.diff(words(parts).first).tolist()

    def asks(i: int) -> bool:
        return parts[i].rstrip().endswith("?") or (sizes[i] <= ASKING and not re.search(r"\d", parts[i]))

    out, n = [(0, sum(sizes))], len(parts)
    front, back = n > 1 and asks(0), n > 1 and asks(n - 1)
    for a, b in ((front, False), (False, back), (front and n > 2, back and n > 2)):
        begin, end = sizes[0] if a else 0, sum(sizes) - (sizes[-1] if b else 0)
        if (a or b) and end - begin >= max(sizes[0] if a else 0, sizes[-1] if b else 0):
            out.append((begin, end))
    return [r for r in dict.fromkeys(out) if r[1] > r[0]]


class Slips:
    """Forms of the items' words: two words share one if a slip in a letter turns them into each other.

    ``of`` gives every word of a text the form of the item word it may stand for, or 0.
    """

    BITS = 22

    def __init__(self, ws: Words) -> None:
        s = ws.shapes()
        self.own, word = np.unique(s.own, return_inverse=True)
        at, less = s.less(np.ones(len(s.own), bool))
        keys = np.concatenate([self.own, less])
        word = np.concatenate([np.arange(len(self.own)), word[at]])
        self.keys, place = np.unique(keys, return_inverse=True)
        form = np.arange(len(self.own))
        while len(form):  # the least word that can be reached over shared keys
            least = np.full(len(self.keys), len(form))
            np.minimum.at(least, place, form[word])
            after = form.copy()
            np.minimum.at(after, word, least[place])
            if (after == form).all():
                break
            form = after
        self.form = np.empty(len(self.keys), np.uint64)
        self.form[place] = self.own[form[word]]
        self.known = np.zeros(1 << self.BITS, bool)
        self.known[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``keys`` of those that items have, their forms)"""
        maybe = np.flatnonzero(self.known[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        same = self.keys[place] == keys[maybe]
        return maybe[same], self.form[place[same]]

    def of(self, ws: Words) -> np.ndarray:
        out = np.zeros(len(ws.hash), np.uint64)
        if len(self.keys) and len(out):
            s = ws.shapes()
            at, form = self._look(s.own)
            out[at] = form
            word, less = s.less(out == 0)
            at, form = self._look(less)
            out[word[at]] = form
        return out


def signatures(windows: np.ndarray, common: np.ndarray) -> np.ndarray:
    """(bands, windows): banded MinHash of windows (rows of word forms).

    ``common`` marks words that many items share; they come after all others, so that a signature
    speaks of the words that tell items apart.
    """
    late = common.astype(np.uint64) << np.uint64(63)
    out = np.empty((BANDS, len(windows)), np.uint64)
    for b in range(BANDS):
        band = np.full(len(windows), np.uint64(b + 1), np.uint64)
        for r in range(ROWS):
            low = ((_mix(windows ^ _SEEDS[b * ROWS + r]) >> np.uint64(1)) | late).min(axis=1)
            with np.errstate(over="ignore"):
                band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + low)
        out[b] = band
    return out


class Index:
    """Banded signatures of the windows of one shape in the items of one size class.

    ``shape`` are the places of a window's words; ``least`` of them have to agree.
    """

    COMMON_SHARE = 0.05

    def __init__(self, shape: list[int], least: int, members: list[int], forms: list[np.ndarray], shortest: list[int]) -> None:
        self.shape, self.least, self.span = np.array(shape), least, shape[-1] + 1
        lengths = [len(forms[i]) for i in members]
        self.flat = np.concatenate([forms[i] for i in members])
        self.item = np.repeat(np.array(members), lengths)
        self.length = np.repeat(np.array(lengths), lengths)
        self.company = np.repeat([max(2, (shortest[i] + 1) // 2 - 1) for i in members], lengths)
        self.offset = np.arange(len(self.item)) - np.repeat(np.cumsum([0, *lengths[:-1]]), lengths)
        self.vocabulary, n_items = np.unique(np.concatenate([np.unique(forms[i]) for i in members]), return_counts=True)
        self.often = n_items > max(2, self.COMMON_SHARE * len(members))
        w = self.span
        within = np.flatnonzero(self.item[: len(self.item) - w + 1] == self.item[w - 1 :]) if len(self.item) >= w else np.empty(0, np.int64)
        keys = self._signed(self.flat, within).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], np.tile(within, BANDS)[order]

    def _signed(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        windows = h[at[:, None] + self.shape]
        place = np.minimum(np.searchsorted(self.vocabulary, windows), len(self.vocabulary) - 1)
        return signatures(windows, self.often[place] & (self.vocabulary[place] == windows))

    def hits(self, h: np.ndarray, ws: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, flat item word) where enough words of a window of a text and of one of an item agree; ``h`` are the text's forms."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        w = self.span
        if len(h) < w or not len(self.keys):
            return none
        known = (h != 0).astype(np.int8)
        n = len(h) - w + 1
        # a window can only agree if that many of its words occur in items at all
        total = sum(known[t : t + n] for t in self.shape)
        at = np.flatnonzero((total >= self.least) & (ws.doc[:n] == ws.doc[w - 1 :]))
        if not len(at):
            return none
        pairs = []
        for band in self._signed(h, at):
            a, b = np.searchsorted(self.keys, band, "left"), np.searchsorted(self.keys, band, "right")
            m = b - a
            p, a, m = at[m > 0], a[m > 0], m[m > 0]
            for i in range(0, len(p), 20_000):  # bounds the memory of a batch that is full of hits
                pi, ai, mi = p[i : i + 20_000], a[i : i + 20_000], m[i : i + 20_000]
                q = self.at[np.repeat(ai, mi) + np.arange(mi.sum()) - np.repeat(np.cumsum(mi) - mi, mi)]
                pi = np.repeat(pi, mi)
                same = sum((h[pi + t] == self.flat[q + t]).astype(np.int8) for t in self.shape)
                good = same >= self.least
                pi, q = pi[good], q[good]
                if self.least == 2 and len(pi):
                    good = self._company(h, ws, pi, q)
                    pi, q = pi[good], q[good]
                pairs.append(pi * len(self.flat) + q)
        pair = np.unique(np.concatenate(pairs)) if pairs else none[0]
        return pair // len(self.flat), pair % len(self.flat)

    def _company(self, h: np.ndarray, ws: Words, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether about half of a short item's words stand where two of them led to, one place aside or blacked out."""
        start, n, count = q - self.offset[q], self.length[q], np.zeros(len(p), np.int64)
        for j in range(int(n.max())):
            on = np.flatnonzero(j < n)
            want, met = self.flat[start[on] + j], np.zeros(len(on), bool)
            for aside in (-1, 0, 1):
                d = p[on] + j - self.offset[q[on]] + aside
                inside = (d >= 0) & (d < len(h))
                d = np.where(inside, d, 0)
                met |= inside & (ws.doc[d] == ws.doc[p[on]]) & ((h[d] == want) | (ws.hash[d] == BLACK_HASH))
            count[on] += met
        return count >= self.company[q]


#: Shapes of windows by size class: least and most words of an item, places of the window's words, how many have to agree.
CLASSES = [(1, 1, [0], 1), (2, RUN - 1, [0, 1], 2), (3, RUN - 1, [0, 2], 2), (RUN, None, list(range(6)), 5)]


def _close(a: str, b: str) -> bool:
    """Whether one letter more, less, other or swapped with its neighbour turns ``a`` into ``b``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


@lru_cache(200_000)
def alike(a: str, b: str) -> bool:
    """Equal, but for a slip in a single letter or what scanning takes for the same shape."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 2 or a == "█" or b == "█":
        return False
    return _close(a, b) or _close(a.replace("rn", "m").translate(_SAME), b.replace("rn", "m").translate(_SAME))


def _step(doc: list[str], i: int, item: list[str], j: int, joined) -> tuple[int, int] | None:
    """How many words of the text and of the item go together at (i, j)."""
    a = doc[i]
    if alike(a, item[j]):
        return 1, 1
    if i + 1 < len(doc) and doc[i + 1] != "█" and alike(joined(a, doc[i + 1]), item[j]):
        return 2, 1
    if j + 1 < len(item) and alike(a, joined(item[j], item[j + 1])):
        return 1, 2
    return None


def _follow(doc: list[str], i: int, item: list[str], j: int, header: set[str], joined, steps: list[tuple[int, int]]) -> list[tuple[int, bool]]:
    """(item word, whether it was read and not blacked out) from (i, j) on, as far as the text follows.

    ``steps`` takes the places in the text and in the item that were gone through.
    """
    out: list[tuple[int, bool]] = []
    while i < len(doc) and j < len(item):
        if step := _step(doc, i, item, j, joined):
            out += [(j + k, True) for k in range(step[1])]
            steps.append((i, j))
            i, j = i + step[0], j + step[1]
            continue
        if doc[i] == "█":
            k = i
            while k < len(doc) and doc[k] == "█":
                k += 1
            if k >= len(doc):
                return out + [(x, False) for x in range(j, min(len(item), j + k - i))]
            # the marks stand for one word each, or for as many as make the next word fit
            for over in sorted(range(1, MAX_BLACK + 1), key=lambda n: (abs(n - (k - i)), n)):
                if j + over < len(item) and _step(doc, k, item, j + over, joined):
                    out += [(x, False) for x in range(j, j + over)]
                    i, j = k, j + over
                    break
                if j + over == len(item) and over <= k - i:
                    return out + [(x, False) for x in range(j, j + over)]
            else:
                return out
            continue
        for over in range(1, MAX_HEADER + 1):
            if i + over >= len(doc) or not (doc[i + over - 1] in header or (doc[i + over - 1].isdigit() and len(doc[i + over - 1]) <= 4)):
                return out
            if _step(doc, i + over, item, j, joined):
                i += over
                break
        else:
            return out
    return out


def longest(doc: list[str], at: int, item: list[str], q: int, header: set[str], passed: set[tuple[int, int]], parts: list[tuple[int, int]]) -> tuple[int, bool]:
    """(longest run of successive words, whether all words of one of ``parts`` are there) of the item around (at, q).

    The places that the path goes through are added to ``passed``.
    """
    ahead, behind = [], []
    forth = _follow(doc, at, item, q, header, lambda a, b: a + b, ahead)
    back = _follow(doc[:at][::-1], 0, item[:q][::-1], 0, header, lambda a, b: b + a, behind)
    passed.update(ahead, ((at - 1 - i, q - 1 - j) for i, j in behind))
    path = [(q - 1 - j, read) for j, read in reversed(back)] + forth
    best = run = 0
    for _, read in path:
        run = run + 1 if read else 0
        best = max(best, run)
    met, seen = np.zeros(len(item) + 1, np.int64), np.zeros(len(item) + 1, np.int64)
    for j, read in path:
        met[j + 1], seen[j + 1] = 1, max(seen[j + 1], read)
    met, seen = met.cumsum(), seen.cumsum()
    whole = any(met[b] - met[a] == b - a and 2 * (seen[b] - seen[a]) >= b - a for a, b in parts)
    return best, whole


def header_words(columns: str, text: str) -> set[str]:
    """Words that may stand in page headers: those of the columns, and of the text's own heading and page headers.

    A case number counts in every spelling, with and without spaces and hyphens between its parts.
    """
    out = {normal(x) for x in re.split(r"\s+", columns)} | {normal(x) for x in re.split(r"[^\w]+", columns)}
    cases = re.findall(_CASE, columns)
    found = [m for m in (_HEADING.match(text), *_PAGE.finditer(text)) if m]
    for m in found:
        out |= {normal(x) for x in m.group(1).split()}
        cases.append(m.groups()[1:])
    for parts in cases:
        chamber, register, number, year = map(normal, parts)
        out |= {chamber, register, number + year, chamber + register, register + number + year, chamber + register + number + year, number, year}
    return (out - {""}) | _HEADER_WORDS


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words, or of the whole if it is shorter."""
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
    with np.errstate(over="ignore"):
        for t in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[t : t + len(out)])
    return out


class Finder:
    """Items of one block, ready to be looked for in batches of texts."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.ids = ids
        ws = words(texts)
        self.parts = [readings(t) for t in texts]
        self.words = [[ws.text(i) for i in range(ws.first[k], ws.first[k + 1])] for k in range(len(ids))]
        hashes = [ws.hash[ws.first[k] : ws.first[k + 1]] for k in range(len(ids))]
        self.shingles = [np.unique(shingles(h)) for h in hashes]
        self.slips = Slips(ws)
        form = self.slips.of(ws)
        forms = [form[ws.first[k] : ws.first[k + 1]] for k in range(len(ids))]
        # an item that is short once its question is gone needs the windows of short ones
        least = [min((b - a for a, b in p), default=0) for p in self.parts]
        self.indexes = []
        for low, high, shape, agree in CLASSES:
            members = [k for k, h in enumerate(forms) if len(h) >= low and (high is None or least[k] <= high)]
            if high is not None:
                members = [k for k in members if least[k] >= low]
            if members:
                self.indexes.append(Index(shape, agree, members, forms, least))

    def find(self, texts: list[str | None], headers: list[str]) -> list[tuple[int, object, int, bool, float]]:
        """(text, item id, longest run, whole, share of its shingles) of every leak in ``texts``."""
        ws = words(texts)
        form = self.slips.of(ws)
        best: dict[tuple[int, int], tuple[int, bool]] = {}
        passed: dict[tuple[int, int], set] = {}
        spelled: dict[int, tuple[list[str], set[str]]] = {}
        for index in self.indexes:
            p, q = index.hits(form, ws)
            for at, k, off, d in zip(p.tolist(), index.item[q].tolist(), index.offset[q].tolist(), ws.doc[p].tolist(), strict=True):
                if d not in spelled:
                    spelled[d] = [ws.text(i) for i in range(ws.first[d], ws.first[d + 1])], header_words(headers[d], texts[d] or "")
                text, header = spelled[d]
                at -= int(ws.first[d])
                gone = passed.setdefault((d, k), set())
                for shift in sorted({0, int(index.shape[-1])}):  # a slip may sit on the first word
                    if (at + shift, off + shift) in gone:  # on a path already followed
                        continue
                    n, w = longest(text, at + shift, self.words[k], off + shift, header, gone, self.parts[k])
                    before = best.get((d, k), (0, False))
                    best[d, k] = max(before[0], n), before[1] or w
        out, contained = [], {}
        for (d, k), (n, whole) in sorted(best.items()):
            if n >= RUN or whole:
                if d not in contained:
                    contained = {d: np.unique(shingles(ws.hash[ws.first[d] : ws.first[d + 1]]))}
                share = float(np.isin(self.shingles[k], contained[d]).mean()) if len(self.words[k]) >= SHINGLE else float(whole)
                out.append((d, self.ids[k], n, whole, share))
        return out


def find_leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, header: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, run, whole, contained): every document with an item's passage, or twelve of its words in a row.

    ``run`` is the longest run of the item's words, ``contained`` the share of the item's five-word shingles
    that the document has letter by letter. ``header`` names columns whose words may stand in page headers.
    Null and empty texts hold nothing; an item without words is found nowhere. Items of equal text are found
    alike; a document that occurs twice is reported as often. Items are dealt into blocks of about
    ``block_chars`` letters by a hash of their id; with more than one block, each block's pairs are written
    before the next is indexed, so that the driver never holds more than one.
    """
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    kinds = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, run int, whole boolean, contained double"
    id_type = asked.select("item_id").limit(0).toArrow().schema.field(0).type
    heads = F.concat_ws(" ", *[F.col(c).cast("string") for c in header or []]) if header else F.lit("")
    picked = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), heads.alias("header")).filter(F.col("text").isNotNull())
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = size // block_chars + 1
    found = None
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()  # about ``block_chars`` letters
        sent = documents.sparkSession.sparkContext.broadcast(Finder([r[0] for r in rows], [r[1] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, headers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for k, n in slices(texts):
                    got = sent.value.find(texts[k : k + n], headers[k : k + n])
                    if got:
                        at, item, length, whole, share = zip(*got, strict=True)
                        ids = batch.column(0).slice(k, n).take(pa.array(at, pa.int64()))
                        yield pa.record_batch([ids, pa.array(item, id_type), pa.array(length, pa.int32()), pa.array(whole, pa.bool_()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "run", "whole", "contained"])

        one = picked.mapInArrow(run, schema)
        if blocks > 1:
            one = store(one, "leaks").df
            sent.unpersist()
        found = one if found is None else found.unionByName(one)
    return found
