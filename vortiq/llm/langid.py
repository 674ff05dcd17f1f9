"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

A word's letters name its script, and the languages that training found in that script are its candidates. Hashed
letter sequences of one to three letters score the word for each of them. The best path over the words, which pays a
penalty at every change of language, labels spans; the language of most letters is the document's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate

#: Scripts by ranges of code points: first, last, name. Other letters are of script "other".
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x1E00, 0x1EFF, "latin"), (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"),
    (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0xAC00, 0xD7AF, "hangul"), (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0x20000, 0x2FFFF, "han"),
]
BUCKETS = 1 << 15
WORD = r"\p{L}[\p{L}\p{M}]*+"
FAR = -60.0


_STARTS = np.array([a for a, _, _ in sorted(SCRIPTS)])
_ENDS = np.array([b for _, b, _ in sorted(SCRIPTS)])
_NAMES = [*dict.fromkeys(name for _, _, name in sorted(SCRIPTS)), "other"]
_WHICH = np.array([_NAMES.index(name) for _, _, name in sorted(SCRIPTS)] + [len(_NAMES) - 1])


def scripts(letters: np.ndarray) -> np.ndarray:
    """Number of the script (in _NAMES) of each code point."""
    at = np.searchsorted(_STARTS, letters, "right") - 1
    return _WHICH[np.where((at >= 0) & (letters <= _ENDS[at]), at, len(_STARTS))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many words at once: buckets of the sequences of 1 to 3 letters that begin at each letter (3 x letters; the
    ends of a word count as letters), where each word begins, its number of sequences, and its script.

    A bucket is BUCKETS where a sequence would reach beyond its word.
    """
    lower = [f"<{w}>" for w in map(str.lower, words)]
    size = np.fromiter(map(len, lower), dtype=np.int64, count=len(lower))
    first = np.cumsum(size) - size
    c = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    left = np.repeat(first + size, size) - np.arange(len(c))
    following = np.r_[c[1:], np.zeros(1, np.uint64)]
    third = np.r_[c[2:], np.zeros(min(2, len(c)), np.uint64)]
    mixed = np.stack([c, c * np.uint64(0x10001) + following + np.uint64(1 << 40), (c * np.uint64(0x10001) + following) * np.uint64(0x100000B3) + third + np.uint64(1 << 50)])
    out = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS
    out[1, left < 2] = BUCKETS
    out[2, left < 3] = BUCKETS
    return out, first, 3 * size - 3, scripts(c[first + 1])


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Model:
    """languages; table: log probabilities (BUCKETS x languages); candidates: of each script, which languages."""

    def __init__(self, languages: list[str], table: np.ndarray, candidates: dict[str, np.ndarray], penalty: float, max_words: int = 400_000):
        self.languages, self.table, self.candidates, self.penalty, self.max_words = languages, table, candidates, penalty, max_words
        self._rows = np.concatenate([table, np.zeros((1, len(languages)), np.float32)]).astype(np.float32)
        self._barred = np.stack([~candidates[n] if n in candidates else np.zeros(len(languages), bool) for n in _NAMES])
        self._known: dict[str, int] = {}
        self._scores = np.zeros((1024, len(languages)), dtype=np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """Scores (words x languages), 0 at best: the sum over a word's sequences over the root of their number."""
        buckets, first, n, of = grams(words)
        got = self._rows[buckets[0]]
        got += self._rows[buckets[1]]
        got += self._rows[buckets[2]]
        total = np.add.reduceat(got, first, axis=0) / np.sqrt(n, dtype=np.float32)[:, None]
        total[self._barred[of]] = FAR
        return np.maximum(total - total.max(1, keepdims=True), FAR)

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of the words of a text (languages x words); those of at most max_words words are remembered."""
        known = self._known
        at = list(map(known.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, k in zip(words, at) if k is None))
            if len(known) + len(new) > self.max_words and known:
                known.clear()
                new = list(dict.fromkeys(words))
            begin, end = len(known), len(known) + len(new)
            if end > len(self._scores):
                self._scores = np.concatenate([self._scores, np.zeros((max(end - len(self._scores), len(self._scores)), len(self.languages)), np.float32)])
            for k in range(0, len(new), 1 << 16):
                self._scores[begin + k : begin + min(k + (1 << 16), len(new))] = self.words(new[k : k + (1 << 16)])
            known.update(zip(new, range(begin, end)))
            at = list(map(known.__getitem__, words))
        return np.ascontiguousarray(self._scores[at].T)

    def path(self, scores: np.ndarray) -> np.ndarray | int:
        """The best path's language of every word, or a number if it is one throughout.

        A path of s spans pays s - 1 penalties. Where no span of another language gains more than half a penalty over
        the language of the highest sum, no path of two spans or more can beat that language alone. Else Viterbi runs.
        """
        k, n = scores.shape
        top = int(scores.sum(1, dtype=np.float64).argmax())
        for other in range(k):
            if other != top:
                gain = scores[other] - scores[top]
                if gain.max() > 0:
                    gain = np.cumsum(gain, dtype=np.float64)
                    if (gain - np.minimum(np.minimum.accumulate(np.r_[0.0, gain[:-1]]), 0)).max() > self.penalty / 2:
                        break
        else:
            return top
        # a few languages a step: lists are quicker than arrays here
        steps = iter(scores.T.tolist())
        best, came = next(steps), []
        for step in steps:
            most = max(best)
            base = most - self.penalty
            came.append((best.index(most), [b < base for b in best]))
            best = [(b if b >= base else base) + x for b, x in zip(best, step)]
        now = best.index(max(best))
        out = np.empty(n, dtype=np.int64)
        out[-1] = now
        for t in range(n - 2, -1, -1):
            lead, moved = came[t]
            if moved[now]:
                now = lead
            out[t] = now
        return out

    def identify(self, text: str, find) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, its share of the letters, and spans (start, end, language) by code points, end exclusive."""
        words = find(text)
        if not words or not self.languages:
            return "und", 0.0, []
        path = self.path(self.scores(words))
        if isinstance(path, int):
            return self.languages[path], 1.0, [(0, len(text), self.languages[path])]
        letters = np.bincount(path, weights=np.fromiter(map(len, words), dtype=np.float64, count=len(words)), minlength=len(self.languages))
        top = int(letters.argmax())
        if (path == path[0]).all():
            return self.languages[top], 1.0, [(0, len(text), self.languages[top])]
        spans, at, ends = [], 0, []
        for w in words:
            at = text.index(w, at) + len(w)
            ends.append(at)
        start = k = 0
        for lang, run in groupby(path.tolist()):
            k += sum(1 for _ in run)
            end = ends[k] - len(words[k]) if k < len(words) else len(text)
            spans.append((start, end, self.languages[lang]))
            start = end
        return self.languages[top], float(letters[top] / letters.sum()), spans


def train(docs: DataFrame, max_docs: int = 6000, penalty: float = 8.0) -> Model:
    """Learns from text and lang of about max_docs rows outside the held-out fifth, chosen by a hash of doc_id.

    Spark counts the hashed sequences; the driver gets BUCKETS numbers a language, whatever the corpus. Rows with a
    null lang, text or id teach nothing; with no rows left, every document is und.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    total = rows.select("doc_id").count()
    share = min(1 << 20, -(-(max_docs << 20) // max(total, 1)))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).where("text is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(WORD).findall
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words.setdefault(lang, Counter()).update(find(text))
            out: list[tuple] = []
            for lang, counts in words.items():
                sums, letters = np.zeros(BUCKETS + 1, dtype=np.int64), Counter()
                own, times = list(counts), np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                for k in range(0, len(own), 1 << 16):
                    part, n = own[k : k + (1 << 16)], times[k : k + (1 << 16)]
                    buckets, _, _, of = grams(part)
                    each = np.repeat(n, [len(w.lower()) + 2 for w in part])
                    for row in buckets:
                        sums += np.bincount(row, each, BUCKETS + 1).astype(np.int64)
                    for w, m, x in zip(part, n, of):
                        letters[_NAMES[x]] += int(m) * len(w)
                out += [(lang, str(int(i)), int(sums[i])) for i in np.flatnonzero(sums[:BUCKETS])] + [(lang, s, n) for s, n in letters.items()]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "key", "n"])

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((BUCKETS, len(languages)), 0.5)
    shares: dict[str, np.ndarray] = {}
    for lang, key, n in zip(*(counts.column(c).to_pylist() for c in ("lang", "key", "n"))):
        k = languages.index(lang)
        if key.isdigit():
            table[int(key), k] += n
        else:
            shares.setdefault(key, np.zeros(len(languages)))[k] += n
    table = np.log(table / table.sum(0)) if languages else table
    letters = sum(shares.values()) if shares else np.zeros(0)
    return Model(languages, table.astype(np.float32), {s: n >= 0.01 * letters for s, n in shares.items() if (n >= 0.01 * letters).any()}, penalty)


def label(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The given columns of docs, with lang_pred, score and spans of every whole text.

    lang_pred is the language of most letters, score its share of them; spans are (start, end, lang) by code points.
    A null text or one without letters is und with score 0 and no span. One row for each input row. A prefix keeps the
    new names apart from those of docs.
    """
    parts = (model.languages, model.table, model.candidates, model.penalty)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def work():
        import regex

        find, own = regex.compile(WORD).findall, Model(*parts)

        def of(texts: list[str]) -> list[pa.Array]:
            langs, shares, parts_of = list(zip(*(own.identify(t, find) for t in texts))) or [()] * 3
            return [pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in s] for s in parts_of], spans)]

        return of

    return annotate(docs, columns, "lang_pred string, score double, spans array<struct<start: bigint, end: bigint, lang: string>>", work, prefix)


def identify(docs: DataFrame, max_docs: int = 6000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every document; see train() and label()."""
    got = label(docs, train(docs, max_docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
