"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its evidence are features of the line and of its neighbours, and
transitions tie adjacent lines together.  Forward-backward gives each line's marginal; a document's
quality is the length-weighted share of good lines, put on the scale of a probability by a logistic
curve.  Only documents are labelled, so lines of bad documents are first taken as bad, and later
rounds let the field itself say which of them are.

Model fitting uses a sample of at most ``sample`` labelled documents, whole texts; scoring is one
pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import own_columns

_OWN = 13
_NEAR = (1, 2, 3, 4, 5, 12)
_MARKS = "#*$%&|<>{}[]\\^~="
_TINY = 1e-4


def _own_features(line: str, seen: bool) -> list[float]:
    words = line.split()
    n, size = len(words), len(line) or 1
    if not n:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    letters = sum(map(len, words))
    marks = sum(map(line.count, _MARKS))
    upper = 0 if line.islower() else sum(map(str.isupper, line))
    return [
        1.0,
        sum(map(eq, words, words[1:])) / n,
        1.0 - len(set(words)) / n,
        min(1.0, line.count("!") / n),
        marks / letters,
        upper / letters,
        sum(map(line.count, "0123456789")) / letters,
        min(1.0, letters / n / 12),
        log(size) / 8,
        float(words[-1][-1] in ".!?:;。"),
        float(seen),
        0.0,
        sum(word[-1] in _MARKS for word in words) / n,
    ]


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line, its neighbours' included, and the lines' lengths (plus one)."""
    lines = text.split("\n")
    before: set[str] = set()
    own = np.empty((len(lines), _OWN))
    for i, line in enumerate(lines):
        own[i] = _own_features(line, line in before)
        before.add(line)
    near = own[:, _NEAR]
    none = np.zeros((1, len(_NEAR)))
    features = np.hstack((own, np.vstack((none, near[:-1])), np.vstack((near[1:], none))))
    return features, np.array([len(line) + 1.0 for line in lines])


WIDTH = _OWN + 2 * len(_NEAR)


@dataclass
class Model:
    """Evidence for bad by feature, transition scores, and the logistic curve of a document."""

    weights: np.ndarray
    step: np.ndarray
    slope: float
    offset: float


def bad_marginals(evidence: list[float], step: np.ndarray) -> list[float]:
    """Probability that each line of one document is bad.

    ``evidence`` is each line's score for bad against good; ``step[a][b]`` that of ``b`` after ``a``.
    """
    (gg, gb), (bg, bb) = np.exp(step).tolist()
    n = len(evidence)
    odds = [exp(min(30.0, max(-30.0, e))) for e in evidence]
    ahead, good, bad = [], 1.0, odds[0]
    for i in range(n):
        if i:
            good, bad = good * gg + bad * bg, (good * gb + bad * bb) * odds[i]
        total = good + bad
        good, bad = good / total, bad / total
        ahead.append((good, bad))
    out, good, bad = [0.0] * n, 1.0, 1.0
    for i in range(n - 1, -1, -1):
        a, b = ahead[i][0] * good, ahead[i][1] * bad
        out[i] = b / (a + b)
        weight = odds[i] * bad
        good, bad = gg * good + gb * weight, bg * good + bb * weight
        total = good + bad
        good, bad = good / total, bad / total
    return out


def bad_share(marginals: list[float], length: np.ndarray) -> float:
    return float(np.dot(marginals, length) / length.sum())


def _logit(share: float) -> float:
    share = min(1 - _TINY, max(_TINY, share))
    return log(share / (1 - share))


def document_score(text: str, model: Model) -> tuple[float, float, list[float]]:
    """Quality from 0 to 1, the share of bad lines, and every line's probability to be bad."""
    features, length = line_features(text)
    marginals = bad_marginals((features @ model.weights).tolist(), model.step)
    share = bad_share(marginals, length)
    z = model.offset + model.slope * _logit(share)
    return 1 / (1 + exp(min(60.0, max(-60.0, -z)))), share, marginals


def _chains(size: np.ndarray) -> list[np.ndarray]:
    """Row numbers of documents of like length, one column per document, -1 behind the end."""
    start, out = np.cumsum(size) - size, []
    width = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for w in np.unique(width):
        docs = np.flatnonzero(width == w)
        rows = np.arange(size[docs].max())[:, None]
        out.append(np.where(rows < size[docs], start[docs] + rows, -1))
    return out


def _gradient(
    x: np.ndarray, bad: np.ndarray, chains: list[np.ndarray], weights: np.ndarray, step: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood by weights and transitions, and all marginals."""
    evidence = np.clip(x @ weights, -30, 30)
    marginal, by_step = np.zeros(len(x)), np.zeros((2, 2))
    move = np.exp(step)
    for rows in chains:
        steps, docs = rows.shape
        real = rows >= 0
        local = np.ones((steps, docs, 2))
        local[:, :, 1] = np.where(real, np.exp(evidence[rows]), 1)
        ahead, after = np.empty_like(local), np.ones_like(local)
        ahead[0] = local[0] / local[0].sum(1, keepdims=True)
        for t in range(1, steps):
            now = (ahead[t - 1] @ move) * local[t]
            ahead[t] = np.where(real[t][:, None], now / now.sum(1, keepdims=True), ahead[t - 1])
        for t in range(steps - 2, -1, -1):
            now = (after[t + 1] * local[t + 1]) @ move.T
            after[t] = np.where(real[t + 1][:, None], now / now.sum(1, keepdims=True), 1.0)
        both = ahead * after
        both /= both.sum(2, keepdims=True)
        marginal[rows[real]] = both[:, :, 1][real]
        if steps > 1:
            pair = ahead[:-1, :, :, None] * move * (local[1:] * after[1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            linked = real[1:]
            by_step -= pair[linked].sum(0)
            label = bad[rows].astype(int)
            np.add.at(by_step, (label[:-1][linked], label[1:][linked]), 1)
    return x.T @ (bad - marginal), by_step, marginal


def fit(documents: list[tuple[np.ndarray, np.ndarray]], quality: np.ndarray, rounds: int = 3, steps: int = 120) -> Model:
    """A model from line features of documents and their labels (1 good, 0 bad).

    Both classes weigh the same in the logistic curve only as far as they occur.  Without documents,
    every score is one half.
    """
    if not documents:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, 0.0)
    size = np.array([len(length) for _, length in documents])
    x, chains = np.vstack([f for f, _ in documents]), _chains(size)
    owner = np.repeat(np.arange(len(size)), size)
    bad = (quality[owner] == 0).astype(float)
    weights, step = np.zeros(WIDTH), np.zeros((2, 2))
    for _ in range(rounds):
        values = np.concatenate((weights, step.ravel()))
        mean, square = np.zeros_like(values), np.zeros_like(values)
        for i in range(1, steps + 1):
            by_weight, by_step, _ = _gradient(x, bad, chains, values[:WIDTH], values[WIDTH:].reshape(2, 2))
            slope = np.concatenate((by_weight, by_step.ravel())) / len(x) - 1e-4 * values
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            values = values + 0.15 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-9)
        weights, step = values[:WIDTH], values[WIDTH:].reshape(2, 2)
        # Which lines of bad documents are bad is for the field to say; the worst one always is.
        evidence = x @ weights
        worst = np.full(len(size), -np.inf)
        np.maximum.at(worst, owner, evidence)
        bad = ((quality[owner] == 0) & ((evidence > 0) | (evidence == worst[owner]))).astype(float)
    share = [
        _logit(bad_share(bad_marginals((f @ weights).tolist(), step), length)) for f, length in documents
    ]
    slope, offset = _logistic(np.array(share), quality)
    return Model(weights, step, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's steps for ``y ~ 1 / (1 + exp(-(offset + slope x)))`` with a little damping."""
    design, beta = np.stack((np.ones_like(x), x), 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        change = np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * beta)
        beta += np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-8:
            break
    return float(beta[1]), float(beta[0])


def held_out(id_column: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Model:
    """A model from at most ``sample`` labelled documents that are not held out.

    The sample goes by a hash of the id.  Null labels, null ids and ids without a document are left
    out; a null text is an empty one.  Of an id with several rows, one counts.
    """
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "quality").limit(sample)
    texts = own_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, sizes = [], []
            for text in batch.column(0).to_pylist():
                features, length = line_features(text)
                raw.append(features.astype(np.float32).tobytes())
                sizes.append(length.astype(np.float32).tobytes())
            columns = [pa.array(raw, pa.binary()), pa.array(sizes, pa.binary()), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["features", "length", "quality", "doc_id"])

    rows = texts.select("text", F.col("quality").cast("int"), F.xxhash64("doc_id").alias("doc_id")).mapInArrow(
        run, "features binary, length binary, quality int, doc_id bigint"
    ).collect()
    rows = sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: r["doc_id"])
    documents = [
        (np.frombuffer(r["features"], np.float32).reshape(-1, WIDTH).astype(float),
         np.frombuffer(r["length"], np.float32).astype(float)) for r in rows
    ]
    return fit(documents, np.array([float(r["quality"]) for r in rows]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, n_lines, bad_lines, bad_share`` of every row.

    ``bad_lines`` counts lines that are more likely bad.  A null text is an empty one and is scored
    as one empty line; a null ``doc_id`` and repeated rows are kept; nothing but the text is looked
    at.  A long text is scored whole, in memory that grows with its lines; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["score", "predicted", "n_lines", "bad_lines", "bad_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text in batch.column(1):
                value, share, marginals = document_score(text.as_py(), model)
                row = (value, int(value >= threshold), len(marginals), sum(m > 0.5 for m in marginals), share)
                for values, v in zip(out, row):
                    values.append(v)
            types = [pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            columns = [pa.array(values, t) for values, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    schema = f"doc_id {kind}, score double, predicted int, n_lines bigint, bad_lines bigint, bad_share double"
    return own_columns(docs, id_col, text_col).mapInArrow(run, schema)
