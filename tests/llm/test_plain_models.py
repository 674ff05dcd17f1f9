"""Scores of the quality classifier and of language identification by enumeration of all paths, with features by loops."""

from __future__ import annotations

import unicodedata
import zlib
from itertools import product

import numpy as np
import pytest
import regex

from vortiq.llm import langid, quality

MARKS = "|#%&$*!<>{}[]=\\~^_@"


def plain_line(line, earlier):
    """Features of one line by itself, character by character."""
    kinds = {"lower": 0, "upper": 0, "digit": 0, "space": 0, "mark": 0, "other": 0}
    for c in line:
        kind = unicodedata.category(c)
        if c in MARKS:
            kinds["mark"] += 1
        elif 0x3000 <= ord(c) < 0xE000 or ord(c) >= 0x10000:
            kinds["lower"] += 1
        elif ord(c) >= 0xE000:
            kinds["other"] += 1
        else:
            kinds["upper" if kind in ("Lu", "Lt") else "lower" if kind[0] in "LM" else "digit" if kind[0] == "N" else "space" if kind[0] == "Z" or c in "\t\v\f\r" else "other"] += 1
    n, letters = max(len(line), 1), max(kinds["lower"] + kinds["upper"], 1)
    words = line.split()
    k = len(words)
    return [
        (kinds["lower"] + kinds["upper"]) / n, kinds["upper"] / letters, kinds["digit"] / n, kinds["space"] / n, min(4 * kinds["mark"] / n, 2.0), kinds["other"] / n, min(np.log1p(len(line)) / 8, 1.5), float(not line),
        len(set(words)) / k if k else 0.0, sum(a == b for a, b in zip(words, words[1:])) / k if k else 0.0, min((len(line) - k + 1) / k / 20, 2.0) if k else 0.0, float(line[-1:] in (".", "?", "!", "。")), float(line[:1].isupper()), float(line in earlier and k > 0),
    ]


def plain_quality(text, model):
    lines = (text or "").split("\n")
    own = [plain_line(x, lines[:k]) for k, x in enumerate(lines)]
    none = [0.0] * len(own[0])
    rows = [[*own[k], *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none), float(k == 0), float(k == len(own) - 1), 1.0] for k in range(len(own))]
    odds = [float(np.clip(np.dot(r, model["weights"]), -30, 30)) for r in rows]
    total, good = 0.0, np.zeros(len(lines))
    for path in product((0, 1), repeat=len(lines)):
        weight = np.exp(sum(y * s for y, s in zip(path, odds)) + sum(model["moves"][a, b] for a, b in zip(path, path[1:])) - sum(max(s, 0) for s in odds))
        total += weight
        good += weight * np.array(path)
    size = np.array([len(x) + 1.0 for x in lines])
    share = float(good / total @ size / size.sum())
    return 1 / (1 + np.exp(-(model["curve"][0] + model["curve"][1] * (8 * share - 4))))


def test_quality_by_all_paths(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    odd = [None, "", "\n\n", "A", "É! 123 | |\nmit  MIT\nmit  MIT\n　中文。\n\U0001f600 @@@ ～", "a.\n" * 8, "퟿ x\ty"]
    rows = [(-k - 1, t) for k, t in enumerate(odd)] + [(r.doc_id, "\n".join(r.text.split("\n")[:9])) for r in docs.limit(120).collect()]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc, text in rows:
        assert got[doc] == pytest.approx(plain_quality(text, model), rel=1e-7), (doc, text)
    whole = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    short = [r for r in docs.collect() if r.text.count("\n") < 9]
    assert len(short) > 20
    for r in short:
        want = plain_quality(r.text, model)
        assert whole[r.doc_id].score == pytest.approx(want, rel=1e-7) and whole[r.doc_id].predicted == int(want >= 0.5) and whole[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def plain_word(word, model):
    """Scores of a word for every language, sequence by sequence."""
    letters = [ord(c) for c in f"<{word.lower()}>"]
    script = next((name for a, b, name in langid.SCRIPTS if a <= letters[1] <= b), "other")
    total, n = np.zeros(len(model.languages)), 0
    wide = (1 << 64) - 1
    for k in range(len(letters)):
        for size in (1, 2, 3):
            if k + size > len(letters):
                continue
            mixed = letters[k]
            if size > 1:
                mixed = (letters[k] * 0x10001 + letters[k + 1]) & wide
            if size == 3:
                mixed = (mixed * 0x100000B3 + letters[k + 2] + (1 << 50)) & wide
            elif size == 2:
                mixed = (mixed + (1 << 40)) & wide
            total += model.table[(mixed * 0x9E3779B97F4A7C15 & wide) >> 40 & (1 << 24) - 1 & langid.BUCKETS - 1]
            n += 1
    total = total / np.sqrt(n)
    if script in model.candidates:
        total[~model.candidates[script]] = langid.FAR
    return np.maximum(total - total.max(), langid.FAR)


def plain_language(text, model):
    """(languages that share the best path's most letters, their share), from all paths; None without a letter."""
    words = regex.findall(langid.WORD, text or "")
    if not words:
        return None
    scores = np.array([plain_word(w, model) for w in words])
    found = []
    for path in product(range(len(model.languages)), repeat=len(words)):
        found.append((sum(scores[t, k] for t, k in enumerate(path)) - model.penalty * sum(a != b for a, b in zip(path, path[1:])), path))
    best = max(v for v, _ in found)
    out = set()
    for value, path in found:
        if value > best - 1e-3:
            size = np.zeros(len(model.languages))
            for w, k in zip(words, path):
                size[k] += len(w)
            out.add((model.languages[int(size.argmax())], round(float(size.max() / size.sum()), 6)))
    return out


def test_language_by_all_paths(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    rng = np.random.default_rng(4)
    words = {}
    for r in docs.collect():
        words.setdefault(r.lang, []).extend(regex.findall(langid.WORD, r.text)[:200])
    langs = sorted(words)
    texts = [None, "", "123 !?", "Ω", "Привет мир", "é", "A" * 50, "und"]
    for k in range(60):
        a, b = rng.choice(langs, 2)
        n = int(rng.integers(1, 7))
        cut = int(rng.integers(0, n + 1))
        texts.append(" ".join(str(rng.choice(words[a if i < cut else b])) for i in range(n)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mixed = 0
    for r in langid.label(df, model).collect():
        want = plain_language(texts[r.doc_id], model)
        if want is None:
            assert r.lang_pred == "und" and r.score == 0 and not r.spans
        else:
            assert (r.lang_pred, round(r.score, 6)) in want, texts[r.doc_id]
            mixed += len(r.spans) > 1
    assert mixed > 0
