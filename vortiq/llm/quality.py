"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Features of a line and its two neighbours score it, learned transitions tie it to the line
before; forward-backward marginals, weighted by line length, give a document's share of good text, and a logistic
curve turns that into a probability. Labels exist for documents only: a first pass without transitions takes a
document's label for each of its lines, then lines of bad documents that look good change sides, and the field is
fitted to that.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate

CLASSES = 7  # other, lower case, upper case, digit, white space, line end, marks that decorate
N_OWN = 14
N_FEATURES = 3 * N_OWN + 3
_TABLE: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point, by its general category."""
    if not _TABLE:
        table = np.zeros(sys.maxunicode + 1, dtype=np.int8)
        for c in range(0x3000):
            kind = unicodedata.category(chr(c))
            table[c] = 2 if kind in ("Lu", "Lt") else 1 if kind[0] in "LM" else 3 if kind[0] == "N" else 4 if kind[0] == "Z" or c in (9, 11, 12, 13) else 0
        table[0x3000:0xE000] = 1
        table[0x10000:] = 1
        table[10] = 5
        for c in "|#%&$*!<>{}[]=\\~^_@":
            table[ord(c)] = 6
        _TABLE.append(table)
    return _TABLE[0]


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x N_FEATURES) and lengths of the lines of a whole text; an empty text has one empty line."""
    lines = text.split("\n")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = char_classes()[points]
    of = np.cumsum(kinds == 5) - (kinds == 5)
    counts = np.bincount(of * CLASSES + kinds, minlength=len(lines) * CLASSES).reshape(-1, CLASSES)[: len(lines)].astype(np.float64)
    length = np.array([len(x) for x in lines], dtype=np.float64)
    own = np.zeros((len(lines), N_OWN))
    n = np.maximum(length, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    own[:, 0] = (counts[:, 1] + counts[:, 2]) / n
    own[:, 1] = counts[:, 2] / letters
    own[:, 2] = counts[:, 3] / n
    own[:, 3] = counts[:, 4] / n
    own[:, 4] = counts[:, 6] / n
    own[:, 5] = counts[:, 0] / n
    own[:, 6] = np.minimum(np.log1p(length) / 8, 1.5)
    own[:, 7] = length == 0
    seen: dict[str, int] = {}
    for i, line in enumerate(lines):
        words = line.split()
        k = len(words)
        if k:
            own[i, 8] = len(set(words)) / k
            own[i, 9] = sum(map(str.__eq__, words, words[1:])) / k
            own[i, 10] = min((len(line) - k + 1) / k / 20, 2.0)
        own[i, 11] = line[-1:] in (".", "?", "!", "。")
        own[i, 12] = line[:1].isupper()
        own[i, 13] = line in seen and k > 0
        seen[line] = i
    # a table-like mark between spaces, an exclamation or a decoration: log counts part rare from frequent
    own[:, 4] = np.minimum(own[:, 4] * 4, 2.0)
    out = np.zeros((len(lines), N_FEATURES))
    out[:, :N_OWN] = own
    out[1:, N_OWN : 2 * N_OWN] = own[:-1]
    out[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
    out[0, 3 * N_OWN] = out[-1, 3 * N_OWN + 1] = 1
    out[:, 3 * N_OWN + 2] = 1
    return out, length


def chain(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good, and expected moves (2 x 2), for padded chains.

    scores: log odds of good for each line; mask: which lines exist; moves: log weights from state to state. Forward
    and backward vectors are scaled at every line, so that long documents neither overflow nor vanish.
    """
    docs, steps = scores.shape
    s = np.clip(scores, -30, 30)
    emit = np.stack([np.exp(-np.maximum(s, 0)), np.exp(np.minimum(s, 0))], axis=2)
    move = np.exp(moves)
    ahead = np.empty((steps, docs, 2))
    now = emit[:, 0]
    ahead[0] = now / now.sum(1, keepdims=True)
    for t in range(1, steps):
        now = (ahead[t - 1] @ move) * emit[:, t]
        now /= now.sum(1, keepdims=True)
        ahead[t] = np.where(mask[:, t, None], now, ahead[t - 1])
    marginal = np.zeros((docs, steps))
    expected = np.zeros((2, 2))
    back = np.ones((docs, 2))
    for t in range(steps - 1, -1, -1):
        both = ahead[t] * back
        marginal[:, t] = both[:, 1] / both.sum(1)
        if t:
            carry = back * emit[:, t]
            pair = ahead[t - 1][:, :, None] * move[None] * carry[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            expected += pair[mask[:, t]].sum(0)
            new = carry @ move.T
            new /= new.sum(1, keepdims=True)
            back = np.where(mask[:, t, None], new, back)
    return marginal, expected


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in rows)
    out, mask = np.zeros((len(rows), steps, *rows[0].shape[1:])), np.zeros((len(rows), steps), dtype=bool)
    for i, x in enumerate(rows):
        out[i, : len(x)], mask[i, : len(x)] = x, True
    return out, mask


def _adam(value: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(value), np.zeros_like(value)
    for k in range(1, rounds + 1):
        g = gradient(value)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        value = value - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return value


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(features: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, rounds: int = 60) -> dict[str, np.ndarray]:
    """Weights, moves and the calibration, from documents with labels 0 and 1."""
    flat = np.concatenate(features)
    of = np.repeat(np.arange(len(features)), [len(x) for x in features])
    y = labels[of].astype(float)
    n = len(flat)
    weights = _adam(np.zeros(N_FEATURES), lambda w: flat.T @ (_logistic(flat @ w) - y) / n + 1e-4 * w, 300, 0.1)
    looks = _logistic(flat @ weights)
    worst = np.full(len(features), 2.0)
    np.minimum.at(worst, of, looks)
    y = np.where((y == 0) & (looks > 0.5) & (looks > worst[of]), 1.0, y)
    order = np.argsort([len(x) for x in features], kind="stable")
    starts = np.r_[0, np.cumsum([len(x) for x in features])]
    groups = []
    for at in range(0, len(order), 256):
        own = order[at : at + 256]
        x, mask = pad([features[i] for i in own])
        good, _ = pad([y[starts[i] : starts[i + 1]] for i in own])
        both = mask[:, 1:]
        seen = np.array([[((good[:, :-1] == a) & (good[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
        groups.append((x, mask, good, seen))

    def gradient(theta: np.ndarray) -> np.ndarray:
        w, moves = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        g = np.zeros_like(theta)
        for x, mask, good, seen in groups:
            marginal, expected = chain(x @ w, mask, moves)
            g[:N_FEATURES] += np.einsum("dt,dtf->f", (marginal - good) * mask, x)
            g[N_FEATURES:] += (expected - seen).ravel()
        return g / n + 1e-4 * theta

    theta = _adam(np.r_[weights, np.zeros(4)], gradient, rounds, 0.05)
    model = {"weights": theta[:N_FEATURES], "moves": theta[N_FEATURES:].reshape(2, 2), "curve": np.array([0.0, 1.0])}
    share = shares(model, features, lengths)
    curve = np.array([0.0, 1.0])
    design = np.stack([np.ones(len(share)), share * 8 - 4], axis=1)
    for _ in range(30):
        p = _logistic(design @ curve)
        curve = curve - np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), design.T @ (p - labels) + 1e-2 * curve)
    return model | {"curve": curve}


def shares(model: dict[str, np.ndarray], features: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
    """Length-weighted share of good text of each document; an empty line weighs as one character."""
    out = np.zeros(len(features))
    order = np.argsort([len(x) for x in features], kind="stable")
    at = 0
    while at < len(order):
        size = max(1, min(256, 20_000 // len(features[order[min(at + 255, len(order) - 1)]])))
        own = order[at : at + size]
        scores, mask = pad([features[i] @ model["weights"] for i in own])
        marginal, _ = chain(scores, mask, model["moves"])
        for i, row in zip(own, marginal):
            w = lengths[i] + 1
            out[i] = row[: len(w)] @ w / w.sum()
        at += size
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_lines: int = 300) -> dict[str, np.ndarray]:
    """Fits on labelled rows outside the held-out third: about max_docs of them, chosen by a hash of doc_id, of at most
    max_lines lines each. Null labels and ids are left out. Of labels that share an id the greatest counts, of texts that
    share one the last in order, so that repeated rows don't widen the sample. With one label only, the curve alone
    tells it."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    total = known.count()
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1 << 20, -(-(max_docs << 20) // max(total, 1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, quality in zip(*(c.to_pylist() for c in batch.columns)):
                if (text or "").count("\n") < max_lines:
                    x, length = line_features(text or "")
                    rows.append((doc, quality, x.astype("<f4").tobytes(), length.astype("<f4").tobytes()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["doc_id", "quality", "x", "length"])

    texts = docs.select("doc_id", "text").where(chosen).groupBy("doc_id").agg(F.max("text").alias("text"))
    rows = texts.join(known.where(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary, length binary").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return {"weights": np.zeros(N_FEATURES), "moves": np.zeros((2, 2)), "curve": np.array([0.0, 1.0])}
    x = [np.frombuffer(v.as_py(), "<f4").reshape(-1, N_FEATURES).astype(float) for v in rows.column("x")]
    length = [np.frombuffer(v.as_py(), "<f4").astype(float) for v in rows.column("length")]
    return fit(x, length, (rows.column("quality").to_numpy() >= 1).astype(float))


def score(docs: DataFrame, model: dict[str, np.ndarray], columns: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The given columns of docs, and score: the probability of quality 1 of every whole text, from its text alone.

    Null texts count as empty; both have one empty line and a score. One row for each input row. A prefix keeps the new name apart from those of docs.
    """

    def work():
        def of(texts: list[str]) -> list[pa.Array]:
            got = [line_features(t) for t in texts]
            share = shares(model, [x for x, _ in got], [n for _, n in got])
            return [pa.array(_logistic(model["curve"][0] + model["curve"][1] * (share * 8 - 4)))]

        return of

    return annotate(docs, columns, "score double", work, prefix)


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = 3000) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every document; see train() and score()."""
    got = score(docs, train(docs, labels, max_docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
