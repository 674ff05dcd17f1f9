"""Alignment, license scans and divergence of sources against plain versions on small tables."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vortiq.llm import align, divergence, licenses, queries

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def tokens(text):
    """Both tokenizations by their own libraries, as (id, bytes); none if they don't spell the text."""
    if not text:
        return [], []
    a, b = libraries()
    letters = align.byte_letters()
    side_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    side_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    spelled = [b"".join(t for _, t in side) for side in (side_a, side_b)]
    return (side_a, side_b) if spelled == [(" " + text).encode()] * 2 else ([], [])


def spans(side):
    out, at = [], 0
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain_links(side_a, side_b, relation):
    """All pairs, one by one."""
    a, b = spans(side_a), spans(side_b)
    shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
    group = lambda e: next(k for k, s in enumerate(shared) if s >= e)
    linked = {"end": lambda x, y: x[2] == y[2], "overlap": lambda x, y: x[1] < y[2] and y[1] < x[2], "group": lambda x, y: group(x[2]) == group(y[2])}[relation]
    return [(x[0], y[0]) for x in a for y in b if linked(x, y)], a, b, shared


def plain_alignment(texts, relation="end"):
    all_links, told = [], []
    for text in texts:
        links, a, b, shared = plain_links(*tokens(text), relation)
        all_links.append(links)
        parts, start = [], 0
        for end in shared:
            parts.append(",".join(str(i) for i, s, e in a if start < e <= end) + "|" + ",".join(str(i) for i, s, e in b if start < e <= end))
            start = end
        told.append((len(a), len(b), len(shared), len(links), hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""))
    count = Counter(x for links in all_links for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(*t[:4], sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), t[4]) for t, links in zip(told, all_links)]


ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nlines\r\n", "▁ is no space", "<|endoftext|> and </s><unk> <0x41>", "é́ ☃ \U0001f600 naïve", "The quick brown fox. The quick brown fox!", "The quick brown fox. The quick brown fox!", "\x00\x7f", "中文 テスト", "x" * 300, "don't we'll 12345 67", "ﬁ ½    end"]


@pytest.mark.parametrize("relation", align.RELATIONS)
def test_alignment_of_odd_texts(spark, relation):
    df = spark.createDataFrame([(k % 13, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, n_a string")
    got = align.digest(df.repartition(3), JSON, public_tokenizers.PATTERN, MODEL, relation).collect()
    want = plain_alignment(ODD, relation)
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == sorted((k % 13, *w) for k, w in enumerate(want))
    assert any(w[2] == 0 for w in want) and any(w[3] > 5 for w in want)
    none = align.digest(spark.createDataFrame([], df.schema), JSON, public_tokenizers.PATTERN, MODEL)
    assert none.count() == 0


def test_alignment_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 1000").collect()
    want = {r.doc_id: w for r, w in zip(rows, plain_alignment([r.text for r in rows]))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in align.digest(df, JSON, public_tokenizers.PATTERN, MODEL).collect()}
    assert got == want and len(got) > 50
    whole = {r.doc_id: r for r in queries.op11_align(spark, sf).collect()}
    assert all(tuple(whole[d])[1:5] == w[:4] and whole[d].groups_sha256 == w[6] for d, w in want.items()) and len(whole) > len(want)


def test_alignment_by_small_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).unionByName(spark.createDataFrame([(None, "a b a")], "doc_id long, text string"), allowMissingColumns=True)
    sums = lambda size: sorted((r.code, r.links, r.best) for r in align.pair_counts(align.aligned_blocks(docs, (JSON, public_tokenizers.PATTERN, MODEL), "overlap", size)).collect())
    assert sums(200) == sums(1 << 30)
    with pytest.raises(ValueError):
        align.digest(docs, JSON, public_tokenizers.PATTERN, MODEL, "start")


def test_alignment_rows_stay_small(spark):
    """2,000 texts in one block: no row that is written grows with the block."""
    df = spark.createDataFrame([(k, f"text {k} says {k * 7} and {k % 13} more words") for k in range(2000)], "doc_id long, text string").coalesce(1)
    blocks = align.aligned_blocks(df, (JSON, public_tokenizers.PATTERN, MODEL), "end")
    assert blocks.select("block").distinct().count() == 1
    assert blocks.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] < 1000


def test_alignment_of_blocks_with_many_pairs(spark, monkeypatch):
    """Over 65,536 distinct id pairs in one block take wider numbers; smaller blocks of the same texts give the same sums."""
    b = libraries()[1]
    pieces = np.random.default_rng(3).choice([b.id_to_piece(i).replace("▁", " ") for i in range(b.get_piece_size()) if not b.is_byte(i) and not b.is_control(i) and not b.is_unknown(i)], (900, 200))
    df = spark.createDataFrame([(k, "".join(x)) for k, x in enumerate(pieces)], "doc_id long, text string").coalesce(1)
    paths, whole = (JSON, public_tokenizers.PATTERN, MODEL), align.aligned_blocks
    got = []
    for size, wide in ((1 << 30, True), (1 << 16, False)):
        blocks = whole(df, paths, "group", size)
        pairs = blocks.where("code is not null").groupBy("block").count().agg(F.max("count")).first()[0]
        assert (pairs > 1 << 16) == wide
        assert blocks.where(f"code is null and length(which) <> {2 + 2 * wide} * n_links").count() == 0
        monkeypatch.setattr(align, "aligned_blocks", lambda docs, paths, relation, size=size: whole(docs, paths, relation, size))
        got.append(sorted(map(tuple, align.digest(df, *paths, "group").collect())))
    assert got[0] == got[1] and len(got[0]) == 900


def test_groups(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    for row in align.groups(df, JSON, public_tokenizers.PATTERN, MODEL).collect():
        a, b = tokens(ODD[row.doc_id])
        assert [i for g in row.groups for i in g.a] == [i for i, _ in a] and [i for g in row.groups for i in g.b] == [i for i, _ in b]
        assert [g.start for g in row.groups] == [0, *[g.end for g in row.groups][:-1]][: len(row.groups)]


def plain_distance(told, notice):
    """Least edit distance of the notice to any run of whole words."""
    words, best = told.split(), 10**6
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + 2 * len(notice.split()) + 8) + 1):
            run = " ".join(words[i:j])
            if abs(len(run) - len(notice)) < 7:
                row = list(range(len(notice) + 1))
                for x, c in enumerate(run, 1):
                    last, row[0] = row[0], x
                    for y, d in enumerate(notice, 1):
                        last, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, last + (c != d))
                best = min(best, row[-1])
    return best


NOTES = [None, "", "...", "MIT License, the mit-license and limit license", "Released under the MIT Licence.", "GNU Genral Publik License v3", "gnu lesser general public license", "GNU Affero Generl Public License\nversion 3", "Permission is hereby granted, free of chrage, to any persn obtaining a copy of this software and", "Licensed under CC BY-NC 4.0. licensed under cc by-nd 4.0", "apacheé license apache  license", "ſ mit license", "mit\x00license", "all  rights\nreserve", "redistribution and use in sorce and binary form, with or without modification, are permited", "mit mit license license", "This program is free software: you can redistribute it"]


def test_notices_with_errors(spark):
    finder = licenses.Finder(licenses.NOTICES)
    for text in NOTES:
        got = finder.scan(text or "")
        told = " ".join(finder.word.findall((text or "").translate(licenses.LOWERED)))
        least = {n: plain_distance(told, n.text) for n in licenses.NOTICES}
        want = {n.label for n, d in least.items() if d <= n.errors}
        assert set(filter(None, got["labels"].split(","))) == want | set(filter(None, got["base_labels"].split(","))), text
        score = max([1 - d / len(n.text) for n, d in least.items() if d <= n.errors], default=0)
        assert got["score"] == (1 if got["n_base"] else score)
        for s in got["notices"]:
            shown = " ".join(finder.word.findall(text[s["start"] : s["end"]].translate(licenses.LOWERED)))
            assert plain_distance(shown, s["notice"]) <= s["errors"] <= max(n.errors for n in licenses.NOTICES if n.text == s["notice"])


def compared(spark, name, df, tmp_path):
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    mine = queries.queries()[name](spark, str(tmp_path))
    assert sorted(columns) == sorted(mine.columns)
    return sorted(map(tuple, mine.select(*columns).collect()), key=str), sorted(told.fetchall(), key=str)


def test_notices_of_odd_texts(spark, tmp_path):
    long = "word " * 20_000 + "mit license " * 3 + "released under the m1t license"
    rows = [(k % 5 or None, t) for k, t in enumerate([*NOTES, *NOTES, long])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("x")).withColumn("Score", F.lit(2.0))
    mine, theirs = compared(spark, "op12_licenses", df, tmp_path)
    assert mine == theirs and len(mine) == len(rows)
    assert licenses.digest(df.where("false")).count() == 0
    kept = licenses.scan(df, ("doc_id", "labels"))
    assert kept.columns[:2] == ["doc_id", "labels"] and "_own_labels" in kept.columns


def test_piece_of_every_harmed_notice():
    rng, finder = np.random.default_rng(3), licenses.Finder(licenses.NOTICES)
    for notice in licenses.NOTICES:
        for _ in range(4):
            text = list(notice.text)
            for at in rng.choice(range(1, len(text) - 1), notice.errors, replace=False):
                text[at] = rng.choice([text[at] + "q", "q", text[at] if text[at] == " " else ""])
            harmed = f" some text {''.join(text)} behind "
            if plain_distance(harmed, notice.text) <= notice.errors:
                assert notice.label in finder.scan(harmed)["labels"].split(",") or notice.label in finder.scan(harmed)["base_labels"].split(",")


def test_divergence_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["Über", "the", "THE", "ÄRGER", "ärger", "\U0001f600", "x", "a1b", "mixed_case", "\x7f", "ſ"]
    rows = [(int(k % 50), " ".join(rng.choice(words, 12)), ["en", "EN", None, "de"][k % 4 if k % 3 else 0], ["s1", None, "s2", "S1", "z"][int(rng.integers(5))]) for k in range(300)]
    rows += [(None, None, "fr", "only"), (1, "", "fr", None), (2, "123 456", "xx", "alone"), (3, "the " * 5000, "en", "hot"), (4, "the", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("term", F.lit("x"))
    mine, theirs = compared(spark, "op13_divergence", df, tmp_path)
    assert mine == theirs and {"pair", "term"} == {r[2] for r in mine} and any(r[0] == "fr" and r[4] == 0 for r in mine)
    assert divergence.audit(df.where("false")).count() == 0


def test_shares_of_huge_counts(spark):
    n, total, kept = 3_000_000_000_000, 9_000_000_000_001, 70_001
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_neighbours_of_many_equal_vectors(spark):
    """3,000 equal vectors among 4,000: ties go to the smaller ids, whatever a cell passes on."""
    from vortiq.llm import ann

    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 12)).astype(np.float32)
    alike = np.sort(rng.choice(4000, 3000, replace=False))
    x[alike] = 3.0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)
    got: dict = {}
    for r in ann.search(df, "vec_id % 100 = 0", row_block=300, query_block=8, rerank=100).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    wide, hits = x.astype(float), 0
    for q in range(0, 4000, 100):
        scores = wide @ wide[q]
        want = sorted((-scores[v], v) for v in range(4000) if v != q)[:20]
        mine = [got[q][k + 1] for k in range(20)]
        assert all(s == pytest.approx(scores[v], abs=1e-9) for v, s in mine)
        hits += len({v for v, _ in mine} & {v for _, v in want})
        if q in alike:
            assert [v for v, _ in mine] == [int(v) for v in alike if v != q][:20]
    assert hits >= 0.9 * 20 * 40
    only = ann.search(df.where(F.col("vec_id").isin(alike.tolist())), "vec_id = " + str(alike[1])).orderBy("rank").collect()
    assert [r.vec_id for r in only] == [int(alike[0]), *map(int, alike[2:21])]


def test_border_of_equal_scores():
    from vortiq.llm.ann import first_of

    rough = np.array([[1, 0], [1, 5], [1, 5], [2, 5], [1, 7]], np.float32)
    assert sorted(first_of(rough, 3)[:, 0]) == [0, 1, 3] and sorted(first_of(rough, 3)[:, 1]) == [1, 2, 4]


def test_persons_are_one_over_the_corpus(spark):
    """Titles without gender follow the others of the name; initials, apostrophes, capitals and particles are found."""
    import re

    from vortiq.llm import pii

    texts = ["Mrs Ann Lee came.", "Dr Ann Lee rang.", "Prof Ann Lee and Mr Robin Day", "Dr Robin Day, Dr Kim Oh", "Mr J. Smith", "Ms O'Neil", "MR SMITH", "Mr van Dyke", "Mr. John de la Cruz", "020 7946 0958 and 192.168.7.9, 172.20.1.1", "the Dr van is here, Mr x and MISS YOU"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace(df.repartition(3), "key of this test").collect()}
    names = [re.fullmatch(r"(?:Mrs|Dr|Prof) (\w+) (\w+)(?: came\.| rang\.| and .*)", got[k]).groups() for k in range(3)]
    assert len(set(names)) == 1 and "Lee" not in got[0]
    assert re.search(r"Mr (\w+ \w+)$", got[2])[1] == re.match(r"Dr (\w+ \w+),", got[3])[1]
    smith = re.fullmatch(r"Mr J\. (\w+)", got[4])[1]
    assert got[6] == f"MR {smith.upper()}" and smith != "Smith"
    for k, form, gone in ((5, r"Ms \w+", "Neil"), (7, r"Mr van \w+", "Dyke"), (8, r"Mr\. \w+ de la \w+", "Cruz"), (9, r"02\d \d{4} \d{4} and 192\.168\.\d+\.\d+, 172\.(1[6-9]|2\d|3[01])\.\d+\.\d+", "7946")):
        assert re.fullmatch(form, got[k]) and gone not in got[k]
    assert got[10] == texts[10]


def test_secrets_of_a_text_with_very_many(spark):
    """Places add up over chunks; time goes with the number of hits."""
    import time

    from vortiq.llm import secrets

    for n in (secrets.CHUNK - 1, secrets.CHUNK, secrets.CHUNK + 1, 40_000):
        text = "é token=abcdef123 " * n
        began = time.time()
        row = secrets.digest(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
        assert row.n_assign == n and row.spans == ",".join(f"assign:{18 * k + 2}:{18 * k + 17}" for k in range(n))
        assert time.time() - began < 60
