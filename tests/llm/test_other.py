"""Chats, secrets, vectors and the pipeline against plain versions on small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vortiq.llm import ann, chat, embed_dedup, queries, secrets, trigrams
from vortiq.llm.common import connected_components


def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ODD_CHAT = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, "assistant", "</turn>\n<turn role=user>\n&lt; &amp;amp; x"), (2, None, None, "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (None, 0, "user", "☃ \U0001f600"), (3, 5, "assistant", "x" * 100_000), (4, 0, "a\n>\n<turn role=b", "\n\n")]


def test_chat(spark, sf):
    for rows in (ODD_CHAT, [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("seq"), F.lit("q").alias("kind"))
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.format_conversations(df).collect()}
        assert got == plain_chat(rows)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    own = {r.conv_id: r for r in queries.op3_chat(spark, sf).collect()}[-7]
    text = "\\### Assistant: </turn> ok"
    assert own.n_turns == 2 and own.loss_chars == len(text) and own.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_events_fold(spark):
    log = [(1, 1, 1, "delta", "user", "Hel"), (1, 2, 1, "delta", None, "lo"), (1, 3, 2, "delta", "assistant", "bad"), (1, 4, 3, "delta", "user", "later"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "go"), (1, 7, 2, None, None, "od"), (1, 8, 1, "edit", None, "Hi"), (1, 9, 1, "delta", None, "!")]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = sorted((r.turn, r.role, r.text) for r in chat.fold(df).collect())
    assert (1, "user", "Hi!") in got and [t for t in got if t[0] == 2][0][2] == "good" and not any(t[0] == 3 and t[2] for t in got)


KINDS = [("assign", re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def plain_secrets(text):
    spans = []
    for number, (name, pattern, group, least) in enumerate(KINDS):
        spans += [(m.start(), number, m.end(), name) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(spans)


ODD_TEXTS = [(1, None), (2, ""), (3, "token=abc token = 'abcdefg' TOKEN:\"xyz12345\" passwd: a.b-c_d="), (4, "AKIA" + "A1" * 8 + " AKIA" + "A" * 15 + " " + "0f" * 12 + "g" + "a" * 23), (5, "☃\U0001f600 api_key==" + "q" * 9 + " apikey : 'z' secret password=" + "e" * 30), (5, "☃\U0001f600 api_key==" + "q" * 9 + " apikey : 'z' secret password=" + "e" * 30), (None, "ghp_" + "a" * 40 + " tokentoken=aaaaaa"), (7, "x" * 300_000 + " token=abcdef123"), (8, "-----BEGIN RSA PRIVATE KEY----- postgres://u:pw@h "), (9, "ſecret=abcdefgh toKen=abcdefgh")]


def test_secrets(spark, sf):
    for df in (spark.createDataFrame(ODD_TEXTS, "doc_id long, text string"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        df = df.select("*", F.lit("c").alias("key"), F.lit("c").alias("rules"), F.lit("c").alias("spans"))
        rows = df.collect()
        got = secrets.digest(secrets.scan(df)).collect()
        want = []
        for r in rows:
            spans = plain_secrets(r.text)
            shown = ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)
            want.append((r.doc_id or -1, *[sum(s[3] == k[0] for s in spans) for k in KINDS], hashlib.sha256(shown.encode()).hexdigest()))
        assert sorted((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    found = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(spark.createDataFrame(ODD_TEXTS, "doc_id long, text string"))).collect()}
    assert "private_key:0:31" in found[8] and "login:" in found[8] and "github:0:44" in found[None]
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trigram_queries_are_sound():
    samples = {"assign": ['password="abcdef"', "API_KEY: xxxxxx", "apikey=1234567"], "access": ["AKIA" + "Z" * 16], "jwt": ["eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10], "bearer": ["Bearer " + "a" * 20]}
    for rule in [*secrets.BASE, *secrets.MORE]:
        q = trigrams.query(rule.pattern)
        for s in samples.get(rule.name, []):
            assert q is None or any(all(t in s.lower() for t in part) for part in q)
    assert trigrams.query("[0-9a-f]{24,}") is None and trigrams.query("abc|xyz") == frozenset({frozenset({"abc"}), frozenset({"xyz"})})


def vectors(seed=1, n=300, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[100:160] = x[:60] + 0.2 * rng.standard_normal((60, dim))
    x[160:180] = x[100:120] + 0.2 * rng.standard_normal((20, dim))
    x[180:200] = x[5]
    x[200:210] = 3 * x[10:20]
    return x.astype(np.float32)


def plain_links(x, threshold=0.9):
    y = x.astype(float)
    norm = np.sqrt((y * y).sum(1))
    near = (y @ y.T) / (norm[:, None] * norm) >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[k], label[near[k]].min() if near[k].any() else label[k]) for k in range(len(x))])
        if (new == label).all():
            return near.sum(1), label
        label = new


@pytest.mark.parametrize("chunk", [40, 4096])
def test_embedding_links(spark, chunk):
    x = vectors()
    links, label = plain_links(x)
    assert links.sum() > 200
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    bad = spark.createDataFrame([(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [1.0], 1), (905, [float("inf")] + [1.0] * 15, 1)], df.schema)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df.unionByName(bad).withColumn("rep", F.lit(1)).withColumn("n_links", F.lit(1)), block_dims=4, chunk=chunk).collect()}
    assert len(got) == 306
    assert [(got[k].n_links, got[k].component_id, got[k].kept) for k in range(300)] == [(int(a), int(b), k == b) for k, (a, b) in enumerate(zip(links, label))]
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(900, 906))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_neighbours(spark):
    x = vectors(2, 600)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1))
    got = {}
    twice = df.union(df.where("vec_id in (20, 30)"))
    for r in ann.search(twice, "vec_id % 20 = 0", row_block=200, query_block=8, rerank=150).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y = x.astype(float)
    hits = total = 0
    for q in range(0, 600, 20):
        score = (y * y[q]).sum(1)
        want = sorted((k for k in range(600) if k != q), key=lambda k: (-score[k], k))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in mine) and q not in [m[1] for m in mine]
        hits += len(set(want) & {m[1] for m in mine})
        total += 20
    assert hits / total >= 0.9
    few = ann.search(df.where("vec_id < 5").unionByName(spark.createDataFrame([(40, None, 1), (60, [0.0] * 16, 1)], "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1))), "vec_id % 20 = 0").collect()
    both = spark.createDataFrame([(1000, [1.0, 0.1]), (1000, [0.1, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (1000, [1.0, 0.1]), (3, [1e-9 + 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.search(both, "vec_id = 1000").orderBy("rank").collect()] == [(1, 3.0), (2, 2.0), (3, pytest.approx(1.1 + 1e-9, abs=1e-13))]
    assert len(few) == 4 and ann.search(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_neighbours_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    y = np.stack(rows.embedding.to_numpy()).astype(float)
    ids = rows.vec_id.to_numpy()
    got = {}
    for r in ann.search(df, "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        score = y @ y[ids == q][0]
        order = np.lexsort((ids, -score))
        hits += len(got[q] & set(ids[order[ids[order] != q][:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 140)} == {100}


def test_pipeline(spark, sf):
    import corpus_pipeline as P
    import regex

    from vortiq.llm import quality, simhash

    raw = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "quality", "near_duplicates", "pii", "packing"] and P.ORACLE_SQL is None
    docs = raw
    for name, stage in P.STAGES[:-1]:
        done = stage(spark, docs, sf)
        assert done.columns == raw.columns
        rows = {r.doc_id: r for r in done.collect()}
        before = {r.doc_id: r for r in docs.collect()}
        assert rows.keys() <= before.keys()
        if name == "language":
            assert rows.keys() == {k for k, r in before.items() if regex.search(r"\p{L}", r.text or "")}
        if name == "near_duplicates":
            ids = sorted(before)
            prints = [simhash.fingerprint(before[k].text) for k in ids]
            links, label = [[j for j in range(len(ids)) if (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(len(ids))], list(range(len(ids)))
            for _ in ids:
                label = [min(label[j] for j in own) for own in links]
            assert rows.keys() == {ids[k] for k in label}
        if name == "quality":
            model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            found = {k: quality.line_features(r.text or "") for k, r in before.items()}
            one = {k: quality.shares(model, [x], [n])[0] * 8 - 4 for k, (x, n) in found.items()}
            assert rows.keys() == {k for k, s in one.items() if model["curve"][0] + model["curve"][1] * s >= 0}
        if name == "pii":
            assert rows.keys() == before.keys() and not any(re.search(r"@\w+\d?\.example\.com|\b\d{16}\b", rows[k].text or "") and rows[k].text == before[k].text for k in rows)
        docs = spark.createDataFrame(list(rows.values()), raw.schema)
    assert {r.doc_id for r in P.run(spark, sf).collect()} == {r.doc_id for r in docs.collect()}


def test_stages_take_odd_tables(spark, sf):
    import corpus_pipeline as P

    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "a"), (3, "The same words here. " * 3, "en", "s", 1, "a"), (3, "The same words here. " * 3, "en", "s", 1, "b"), (4, "The same words here. " * 3, "en", "s", 1, "c"), (None, "the cat sat on the mat", "en", "s", 3, "d")]
    names = ["score", "_own_n_pii", "lang_pred", "component_id", "repeated", "key"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, x string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for name, stage in P.STAGES:
        done = stage(spark, df, sf)
        kept = done.collect()
        if name != "packing":
            assert done.columns == df.columns
        if name == "language":
            assert sorted(r.doc_id or -1 for r in kept) == [-1, 3, 3, 4]
        if name == "near_duplicates":
            assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 3]
        stage(spark, df.limit(0), sf).collect()
    # an id whose texts lie in two components, one component without any id, and an id's second text like another's
    words = ["alpha beta gamma delta " * 9, "one two three four five " * 9, "red green blue white " * 9]
    odd = [(7, words[0], "a"), (7, words[1], "b"), (8, words[1], "c"), (None, words[2], "d"), (None, words[2], "e"), (None, words[0], "f")]
    kept = dict(P.STAGES)["near_duplicates"](spark, spark.createDataFrame(odd, "doc_id long, text string, x string"), sf).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(7, words[0]), (7, words[1]), (-1, words[2])])
