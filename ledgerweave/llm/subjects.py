"""Subject areas of documents by classifier chains.

Fitting, on a bounded sample of labelled documents (``FIT_DOCUMENTS`` of them, ``FIT_CHARS`` letters):

* term features: words whose presence goes with a subject, by smoothed log odds and a z test; a word
  written with a capital inside a sentence counts as another word, so that what the names of parties and
  courts say is learned apart from what the same word says as a noun,
* structure features: which sentences speak of a subject and, learned from the words around, whether
  such a sentence is about the dispute or mentions the area in passing,
* source features: hashed source and language,
* a chain of logistic models, one per subject in order of frequency, each of which sees the decisions
  before it and so models which subjects occur together. Its probabilities are those of maximum likelihood
  shrunk towards one pooled model; ``reliability`` measures how far they are from seen frequencies.

Scoring decodes the chain by beam search for the most probable combination and reads every document
whole. The model is small (some thousand words) and goes to the tasks as a broadcast.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.words import _mix, slices, words
from ledgerweave.storage import store

FIT_DOCUMENTS = 6000
FIT_CHARS = 24_000_000
MIN_DOCS = 3
LONGEST_SENTENCE = 45
BEAM = 6
_ROUNDS = 300
_CAPITAL = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Sentences:
    """Words of whole texts, with the sentence each belongs to and the text of each sentence."""

    hash: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray  # of each sentence
    n_docs: int


def sentences(texts: list[str | None]) -> Sentences:
    ws = words(texts)
    n = len(ws.hash)
    size = (ws.end - ws.start).astype(np.int64)
    stop = ws.closing & (size > 3)
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        new[1:] = stop[:-1] | (ws.doc[1:] != ws.doc[:-1])
    begin = np.flatnonzero(new)
    since = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n))) if n else np.empty(0, np.int64)
    # a capital inside a sentence makes another word: a name has to earn its own weight
    written = np.where(ws.upper & (since > 0), _mix(ws.hash ^ _CAPITAL), ws.hash)
    new |= (since > 0) & (since % LONGEST_SENTENCE == 0)
    return Sentences(written, np.cumsum(new) - 1, ws.doc[new].astype(np.int64), len(texts))


def gathered(texts: list[str | None]) -> Sentences:
    """``sentences`` of many texts, a slice at a time: only what is kept of each slice adds up."""
    parts, n_sentences, n_docs = [], 0, 0
    for i, n in slices(texts):
        s = sentences(texts[i : i + n])
        parts.append((s.hash, s.sentence + n_sentences, s.doc + n_docs))
        n_sentences, n_docs = n_sentences + len(s.doc), n_docs + s.n_docs
    return Sentences(*[np.concatenate(x) for x in zip(*parts, strict=True)], n_docs)


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``h`` of known words, and their places in the sorted ``table``."""
    if not len(table) or not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(table, h), len(table) - 1)
    at = np.flatnonzero(table[place] == h)
    return at, place[at]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: np.ndarray, steps: int = 25) -> np.ndarray:
    """Newton's method; ``y`` may lie between 0 and 1."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + l2 * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(l2), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    subjects: list[str]
    terms: np.ndarray  # sorted hashes
    weight: np.ndarray  # (terms, subjects)
    cues: np.ndarray  # sorted hashes
    cue_weight: np.ndarray
    cue_bias: float
    pooled: np.ndarray
    chain: list[int]
    links: list[np.ndarray]

    def topical(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, subject) of the sentences that speak of a subject."""
        k = len(self.subjects)
        at, place = _find(self.terms, s.hash)
        score = np.zeros(len(s.doc) * k)
        rows = s.sentence[at]
        for j in range(k):
            w = self.weight[place, j]
            on = w > 0
            np.add.at(score, rows[on] * k + j, w[on])
        score = score.reshape(-1, k)
        best = score.argmax(1) if len(score) else np.empty(0, np.int64)
        rows = np.flatnonzero(score[np.arange(len(score)), best] > 1.2)
        return rows, best[rows]

    def substance(self, s: Sentences, rows: np.ndarray) -> np.ndarray:
        """How likely each of the sentences is about the dispute."""
        at, place = _find(self.cues, s.hash)
        total = np.bincount(s.sentence[at], self.cue_weight[place], len(s.doc))
        return _sigmoid(self.cue_bias + total[rows])

    def features(self, s: Sentences) -> np.ndarray:
        """(texts, subjects, features)"""
        k = len(self.subjects)
        rows, subject = self.topical(s)
        p = self.substance(s, rows)
        key = s.doc[rows] * k + subject
        n = np.bincount(key, minlength=s.n_docs * k).reshape(-1, k).astype(float)
        a = np.bincount(key, p, s.n_docs * k).reshape(-1, k)
        top = np.zeros(s.n_docs * k)
        np.maximum.at(top, key, p)
        none = np.ones(s.n_docs * k)
        np.multiply.at(none, key, 1 - p)
        top, some = top.reshape(-1, k), 1 - none.reshape(-1, k)
        length = np.log1p(np.bincount(s.doc, minlength=s.n_docs))[:, None] * np.ones((1, k))
        others = a.sum(1, keepdims=True) - a
        rival = np.where(np.arange(k) == a.argmax(1)[:, None], np.sort(a, 1)[:, -2:-1] if k > 1 else 0, a.max(1, keepdims=True))
        return np.stack([np.log1p(a), np.log1p(n), top, some, a / (a + others + 0.5), np.log1p(others), np.log1p(rival), (a > rival).astype(float), (n >= 2).astype(float), length], 2)

    def base(self, f: np.ndarray) -> np.ndarray:
        k = len(self.subjects)
        x = np.concatenate([f, np.broadcast_to(np.eye(k), (len(f), k, k))], 2)
        return x @ self.pooled

    def logits(self, f: np.ndarray, side: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(texts, subjects) of the chain, every link being told the true decisions before it."""
        base, out = self.base(f), np.zeros(y.shape)
        for i, (j, w) in enumerate(zip(self.chain, self.links, strict=True)):
            before = np.zeros(y.shape)
            before[:, self.chain[:i]] = y[:, self.chain[:i]] >= 0.5
            out[:, j] = np.concatenate([base[:, j : j + 1], before, side, np.ones((len(f), 1))], 1) @ w
        return out

    def decode(self, f: np.ndarray, side: np.ndarray) -> np.ndarray:
        """The most probable combination of subjects of each text, by beam search along the chain."""
        n, k = len(f), len(self.subjects)
        base = self.base(f)
        labels, score = np.zeros((n, 1, k)), np.zeros((n, 1))
        for j, w in zip(self.chain, self.links, strict=True):
            width = labels.shape[1]
            x = np.concatenate([np.repeat(base[:, None, j : j + 1], width, 1), labels, np.repeat(side[:, None, :], width, 1), np.ones((n, width, 1))], 2)
            p = np.clip(_sigmoid(x @ w), 1e-9, 1 - 1e-9)
            yes = labels.copy()
            yes[:, :, j] = 1
            labels = np.concatenate([yes, labels], 1)
            score = np.concatenate([score + np.log(p), score + np.log(1 - p)], 1)
            if labels.shape[1] > BEAM:
                keep = np.argsort(-score, 1, kind="stable")[:, :BEAM]
                labels, score = np.take_along_axis(labels, keep[:, :, None], 1), np.take_along_axis(score, keep, 1)
        return np.take_along_axis(labels, score.argmax(1)[:, None, None], 1)[:, 0] > 0.5


SIDE = 8


def side_features(sources: list[str | None], langs: list[str | None]) -> np.ndarray:
    out = np.zeros((len(sources), 2 * SIDE))
    for i, (a, b) in enumerate(zip(sources, langs, strict=True)):
        for k, v in enumerate((a, b)):
            if v:
                out[i, k * SIDE + sum(v.lower().encode()) % SIDE] = 1
    return out


def reliability(p: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    """Expected calibration error: mean distance between stated and seen frequency over bins of probability."""
    p, y = p.ravel(), y.ravel()
    at = np.minimum((p * bins).astype(int), bins - 1)
    n = np.bincount(at, minlength=bins)
    return float(np.abs(np.bincount(at, p, bins) - np.bincount(at, y, bins)).sum() / max(1, n.sum()))


def fit(texts: list[str], sources: list, langs: list, y: np.ndarray, subjects: list[str]) -> Model:
    """Fit on texts with ``y`` (texts, subjects): the share of annotators who saw the subject."""
    k, n = len(subjects), len(texts)
    s = gathered(texts)
    doc = s.doc[s.sentence]
    vocabulary, word = np.unique(s.hash, return_inverse=True)
    pair = np.unique(doc * np.int64(len(vocabulary) + 1) + word)
    d, w = pair // (len(vocabulary) + 1), pair % (len(vocabulary) + 1)
    df = np.bincount(w, minlength=len(vocabulary)).astype(float)
    weight = np.zeros((len(vocabulary), k))
    for j in range(k):
        in_s, share = np.bincount(w, y[d, j], len(vocabulary)), (y[:, j].sum() + 0.5) / (n + 1)
        odds = np.log((in_s + 0.5) / (df - in_s + 0.5)) - np.log(share / (1 - share))
        z = (in_s - df * share) / np.sqrt(df * share * (1 - share) + 1e-9)
        weight[:, j] = np.where((df >= MIN_DOCS) & (z > 3.5) & (odds > 0.8), np.minimum(odds, 4), 0)
    weight[weight < weight.max(1, keepdims=True)] = 0  # a word speaks for one subject
    known = weight.max(1) > 0
    model = Model(subjects, vocabulary[known], weight[known], np.empty(0, np.uint64), np.empty(0), 0.0, np.zeros(0), [], [])

    rows, subject = model.topical(s)
    target = y[s.doc[rows], subject]
    row_of = np.full(len(s.doc), -1)
    row_of[rows] = np.arange(len(rows))
    member = (row_of[s.sentence] >= 0) & ~known[word]
    sent, cue = row_of[s.sentence[member]], word[member]
    often = np.bincount(cue, minlength=len(vocabulary)) >= 5
    keep = often[cue]
    sent, cue = sent[keep], cue[keep]
    cues = np.flatnonzero(often)
    place = np.searchsorted(cues, cue)
    cw, bias = np.zeros(len(cues)), 0.0
    gw, gb = np.full(len(cues), 1e-6), 1e-6
    for _ in range(_ROUNDS if len(rows) else 0):
        err = _sigmoid(bias + np.bincount(sent, cw[place], len(rows))) - target
        g = np.bincount(place, err[sent], len(cues)) + 1.0 * cw
        gw += g * g
        cw -= 0.5 * g / np.sqrt(gw)
        gb += err.sum() ** 2
        bias -= 0.5 * err.sum() / gb**0.5
    order = np.argsort(vocabulary[cues])
    model.cues, model.cue_weight, model.cue_bias = vocabulary[cues][order], cw[order], float(bias)

    f = model.features(s)
    x = np.concatenate([f, np.broadcast_to(np.eye(k), (n, k, k))], 2).reshape(n * k, -1)
    model.pooled = _logistic(x, y.reshape(-1), np.full(x.shape[1], 0.3))
    base, side = model.base(f), side_features(sources, langs)
    model.chain = [int(j) for j in np.argsort(-y.sum(0), kind="stable")]
    hard = (y >= 0.5).astype(float)
    for i, j in enumerate(model.chain):
        before = np.zeros((n, k))
        before[:, model.chain[:i]] = hard[:, model.chain[:i]]
        x = np.concatenate([base[:, j : j + 1], before, side, np.ones((n, 1))], 1)
        l2 = np.concatenate([[0.01], np.full(k, 4.0), np.full(2 * SIDE, 20.0), [1.0]])
        # the pooled logit is the starting point: only departures from it are fitted
        model.links.append(_offset_logistic(x, y[:, j], l2))
    return model


def _offset_logistic(x: np.ndarray, y: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Logistic weights shrunk towards 1 for the first column and 0 for the rest."""
    start = np.zeros(x.shape[1])
    start[0] = 1.0
    l2 = l2.copy()
    l2[0] = 5.0
    w = start.copy()
    for _ in range(25):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + l2 * (w - start)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(l2), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(documents: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS, chars: int = FIT_CHARS) -> list:
    """Labelled documents (text, source, lang, [subjects with their share of annotators]) in hash order of their ids.

    At most ``limit`` are taken, and of those as many as have ``chars`` letters together.
    """
    seen = labels.select("doc_id", "annotator", "subject").distinct()
    per = seen.groupBy("doc_id", "subject").agg(F.countDistinct("annotator").alias("n"))
    annotators = seen.groupBy("doc_id").agg(F.greatest(F.countDistinct("annotator"), F.lit(1)).alias("of"))
    marked = per.join(annotators, "doc_id").groupBy("doc_id").agg(F.collect_list(F.when(F.col("subject").isNotNull(), F.struct("subject", (F.col("n") / F.col("of")).alias("share")))).alias("areas"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select("doc_id", "text", "source", "lang").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    sample = store(rows, "sample")  # ``limit`` rows: documents are read once for them
    so_far = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fits = sample.df.select("doc_id", so_far.alias("so_far")).filter(F.col("so_far") <= chars).select("doc_id").distinct()
    got = sample.df.join(fits, "doc_id", "left_semi").collect()
    sample.drop()
    return sorted(got, key=lambda r: (r["doc_id"], r["text"]))


def fit_from(rows: list, subjects: list[str]) -> Model | None:
    if not rows or not subjects:
        return None
    y = np.zeros((len(rows), len(subjects)))
    place = {s: j for j, s in enumerate(subjects)}
    for i, r in enumerate(rows):
        for a in r["areas"]:
            if a["subject"] in place:
                y[i, place[a["subject"]]] = min(1.0, a["share"])
    return fit([r["text"] for r in rows], [r["source"] for r in rows], [r["lang"] for r in rows], y, subjects)


def assign(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject): the subject areas of every document.

    ``documents`` has doc_id, text, source and lang; ``labels`` doc_id, annotator and subject (null: none
    seen; repeated rows count once); ``areas`` the subjects. Null or empty texts have no subject; without
    labelled documents no document has one.
    """
    subjects = sorted(r[0] for r in areas.select("subject").filter(F.col("subject").isNotNull()).distinct().collect())
    sent = documents.sparkSession.sparkContext.broadcast(fit_from(labelled_sample(documents, labels), subjects))
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, n in slices(texts) if model else ():
                part = batch.slice(i, n)
                f = model.features(sentences(texts[i : i + n]))
                at, j = np.nonzero(model.decode(f, side_features(part.column(2).to_pylist(), part.column(3).to_pylist())))
                if len(at):
                    yield pa.record_batch([part.column(0).take(pa.array(at, pa.int64())), pa.array([subjects[x] for x in j], pa.string())], names=["doc_id", "subject"])

    picked = documents.select("doc_id", "text", "source", "lang").filter(F.length(F.trim("text")) > 0)
    return picked.mapInArrow(run, f"doc_id {kind}, subject string")
