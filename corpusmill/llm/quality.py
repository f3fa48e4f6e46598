"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines next to it; forward-backward gives
each line's marginal, and a document's score is their mean weighted by line length, mapped to a probability by a
logistic calibration. Labels exist for documents only, so in training each line carries its document's label. The
field is fitted on the driver from a bounded sample (``SAMPLE_DOCS`` labelled documents of at most ``SAMPLE_LINES``
lines, those with the least hash of their id); features and scores cover every line of every text, in Spark tasks.

Only the text feeds a score. Defined cases: a null or empty text, or one of blank lines, is one empty line; null ids
are scored but never learned from; repeated rows are scored each; labels that are null are ignored, of several labels
of a document the largest counts; without labels of both kinds every score is 0.5; a very long text is one chain, in
memory with some 300 bytes a line; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U64, Fingerprints, mix, slices, text_buffers, words

SAMPLE_DOCS, SAMPLE_LINES = 4000, 400
THRESHOLD, HELD_OUT = 0.3, 5
#: Lines whose features are in memory at once.
BLOCK = 1 << 14
_code = np.arange(256)


def _is(chars: str) -> np.ndarray:
    return np.isin(_code, [ord(c) for c in chars])


#: Classes of bytes whose shares of a line are features.
CLASSES = (
    (_code >= 65) & (_code <= 90),
    (_code >= 97) & (_code <= 122),
    (_code >= 48) & (_code <= 57),
    _is(" \t\r\f\v"),
    _is("!?"),
    _is(".,;:'\"()-"),
    _is("#$%&*@^~"),
    _is("|<>{}[]\\/=+_`"),
    _code >= 128,
    (_code < 32) & (_code != 9) & (_code != 10) & (_code != 13),
)
N_SHARES = len(CLASSES) + 5
N_FEATURES = 4 * N_SHARES + 3 + 2 * (N_SHARES + 1) + 1


def _share_repeated(hashes: np.ndarray, group: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each owner's items, the share whose (group, hash) stands more than once."""
    with np.errstate(over="ignore"):
        key = mix(hashes + mix(group.astype(U64) + U64(11)))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    total = np.bincount(owner, minlength=n)
    return np.bincount(owner, count[back] > 1, n) / np.maximum(total, 1)


class Lines:
    """The lines of some texts, of at least one byte that isn't blank: ``shares`` and ``n_words`` of each, its bytes in
    ``size``, its text in ``doc``, and the ``first`` line of each text. Their many features are made for a range of
    lines at a time, so memory follows the shares."""

    def __init__(self, shares: np.ndarray, size: np.ndarray, n_words: np.ndarray, doc: np.ndarray, n_docs: int):
        self.shares, self.size, self.n_words, self.doc = shares, size, n_words, doc
        self.first = np.searchsorted(doc, np.arange(n_docs + 1))

    def features(self, low: int, high: int) -> np.ndarray:
        at = slice(low, high)
        shares, size = self.shares[at], self.size[at]
        length = np.log1p(size) / 5
        own = [shares, np.sqrt(shares), shares > 0.05, shares > 0.3, length[:, None], (self.n_words[at] / np.maximum(size, 1) < 0.1)[:, None], (size < 30)[:, None]]
        return np.concatenate([*own, self._beside(low, high, -1), self._beside(low, high, 1), np.ones((high - low, 1))], axis=1).astype(np.float64)

    def _beside(self, low: int, high: int, step: int) -> np.ndarray:
        """Shares and length of the line before or after, zero where that is of another text."""
        at = np.clip(np.arange(low, high) + step, 0, len(self.doc) - 1)
        same = (self.doc[at] == self.doc[low:high]) & (at != np.arange(low, high))
        return np.where(same[:, None], np.concatenate([self.shares[at], (np.log1p(self.size[at]) / 5)[:, None]], axis=1), 0.0)

    def evidence(self, weights: np.ndarray) -> np.ndarray:
        """Features times weights."""
        n = len(self.doc)
        return np.concatenate([np.zeros(0), *(self.features(low, min(low + BLOCK, n)) @ weights for low in range(0, n, BLOCK))])


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes of each line, first line of each text)."""
    lines = text_lines(texts)
    return lines.features(0, len(lines.doc)), lines.size, lines.first


def text_lines(texts: pa.Array) -> Lines:
    data, offsets = text_buffers(texts)
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    solid = np.concatenate([[0], np.cumsum((data > 32))])
    kept = solid[end] > solid[start]
    start, end = start[kept], end[kept]
    doc = np.searchsorted(offsets, start, "right") - 1
    absent = np.setdiff1d(np.arange(n_docs), doc)
    # a text without such lines is one empty line
    order = np.argsort(np.concatenate([doc, absent]), kind="stable")
    start, end = (np.concatenate([x, np.zeros(len(absent), np.int64)])[order] for x in (start, end))
    doc = np.concatenate([doc, absent])[order]
    n, size = len(start), end - start
    shares = np.zeros((n, N_SHARES))
    for i, member in enumerate(CLASSES):
        sums = np.concatenate([[0], np.cumsum(member[data])])
        shares[:, i] = (sums[end] - sums[start]) / np.maximum(size, 1)
    word, word_doc, _ = words(data, offsets)
    upto = np.concatenate([[0], np.cumsum(_word_starts(data, offsets))])
    n_words = upto[end] - upto[start]
    line_of = np.repeat(np.arange(n), n_words) if n_words.sum() == len(word) else None
    if line_of is not None and len(word):
        shares[:, -4] = _share_repeated(word, line_of, line_of, n)
        twice = np.flatnonzero((word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1]))
        shares[:, -5] = np.bincount(line_of[twice], minlength=n) / np.maximum(n_words, 1)
        with np.errstate(over="ignore"):
            triple = word.copy()
            triple[:-2] += word[1:-1] * U64(0x9E3779B97F4A7C15) + word[2:] * U64(0xC2B2AE3D27D4EB4F)
        shares[:, -3] = _share_repeated(triple, word_doc, line_of, n)
        shares[:, -2] = np.bincount(line_of, minlength=n) / np.maximum(size, 1) * 4
    prints = Fingerprints(data).of(start, end) if len(data) else np.zeros(n, U64)
    shares[:, -1] = _share_repeated(prints, doc, np.arange(n), n)
    return Lines(shares, size, n_words, doc, n_docs)


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    from .textbytes import LOWER, WORD

    inside = WORD[LOWER[data]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    first[begin] = inside[begin]
    return first


class Field:
    """Weights of a two-label chain: one weight per feature (in favour of good) and a 2 x 2 table of transitions."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.steps, self.slope, self.offset = weights, steps, slope, offset

    def chains(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts by falling number of lines, and for each place in a chain how many texts are that long."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        return order, np.searchsorted(-size[order], -np.arange(1, (size.max() if len(size) else 0) + 1), "right")

    def marginals(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(P(good) of each line, expected transitions, sum of log partition functions), all chains in step."""
        return self.chained(features @ self.weights, first)

    def chained(self, evidence: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """``marginals`` from each line's evidence for good."""
        unary = np.zeros((len(evidence), 2))
        unary[:, 1] = np.clip(evidence, -30, 30)
        order, live = self.chains(first)
        begin, potential = first[:-1][order], np.exp(self.steps)
        alpha, scale = np.zeros((len(evidence), 2)), np.zeros(len(evidence))
        push = np.exp(unary - unary.max(axis=1, keepdims=True))
        for t, n in enumerate(live):
            at = begin[:n] + t
            a = push[at] if t == 0 else (alpha[at - 1] @ potential) * push[at]
            scale[at] = a.sum(axis=1)
            alpha[at] = a / scale[at][:, None]
        beta, pairs = np.ones((len(evidence), 2)), np.zeros((2, 2))
        for t in range(len(live) - 1, 0, -1):
            at = begin[: live[t]] + t
            back = push[at] * beta[at] / scale[at][:, None]
            pairs += (alpha[at - 1].T @ back) * potential
            beta[at - 1] = back @ potential.T
        good = alpha * beta
        return good[:, 1] / good.sum(axis=1), pairs, float(np.log(scale).sum() + unary.max(axis=1).sum())

    def document_logit(self, evidence: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of each document's length-weighted mean marginal."""
        good, weight = self.chained(evidence, first)[0], size + 1.0
        mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: pa.Array) -> np.ndarray:
        lines = text_lines(texts)
        logit = self.document_logit(lines.evidence(self.weights), lines.size, lines.first)
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -40, 40)))


def fit(features: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 120, ridge: float = 1e-4) -> Field:
    """Gradient ascent (Adam) on the regularised log likelihood, then the calibration on the same documents."""
    if not len(label) or label.min() == label.max():
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)))
    lines = np.repeat(label, np.diff(first)).astype(float)
    seen = np.zeros((2, 2))
    for y in (0, 1):
        seen[y, y] = np.maximum(np.diff(first) - 1, 0)[label == y].sum()
    theta, m, v = np.zeros(N_FEATURES + 4), 0.0, 0.0
    field = Field(theta[:-4], theta[-4:].reshape(2, 2))
    for i in range(1, rounds + 1):
        good, pairs, _ = field.marginals(features, first)
        slope = np.concatenate([features.T @ (lines - good), (seen - pairs).ravel()]) / len(lines) - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        field = Field(theta[:-4], np.clip(theta[-4:].reshape(2, 2), -4, 4))
    x, a, b = field.document_logit(features @ field.weights, size, first), 1.0, 0.0
    for _ in range(50):  # Newton's method, slightly damped
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w, g = p * (1 - p) + 1e-6, label - p
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) + 0.7 * np.linalg.solve(h, np.array([(g * x).sum() - 1e-3 * a, g.sum()]))
    return Field(field.weights, field.steps, max(float(a), 1e-3), float(b))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 by five; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fits on labelled documents that are not held out, at most SAMPLE_DOCS of them; of rows that repeat an id one counts."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label is not null")
    known = known.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)  # the bound that makes the broadcast safe
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("one")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"), one).select("doc_id", "label", "one.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            features, size, first = line_features(batch.column("text"))
            for doc_id, label, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), first[:-1], first[1:]):
                if b - a <= SAMPLE_LINES:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id]), "label": pa.array([label], pa.int32()), "size": pa.array([size[a:b]], pa.list_(pa.int64())), "features": pa.array([features[a:b].astype("<f4").tobytes()])})

    got = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, size array<long>, features binary").toArrow().sort_by("doc_id")
    sizes = [np.asarray(x, np.int64) for x in got.column("size").to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(x) for x in sizes])]).astype(np.int64)
    features = np.zeros((first[-1], N_FEATURES))
    for a, b, data in zip(first[:-1], first[1:], got.column("features")):
        features[a:b] = np.frombuffer(data.as_buffer(), "<f4").reshape(-1, N_FEATURES)
    return fit(features, np.concatenate([np.zeros(0, np.int64), *sizes]), first, np.asarray(got.column("label").to_pylist(), np.int64))


def score_quality(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 where the score is at least THRESHOLD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(field.score(batch.column("text")))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out("doc_id"))
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least THRESHOLD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=text_col):
            yield batch.filter(pa.array(field.score(batch.column(text_col)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
