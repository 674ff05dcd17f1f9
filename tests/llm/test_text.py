"""Tokens, fingerprints, languages, quality, personal data and packing against plain versions on small tables."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vortiq.llm import bpe, langid, packing, pii, quality, simhash
from vortiq.llm.common import fresh

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, " \n\t ", "en", "s", 4), (4, "a" * 200_000, "en", "s", 1), (5, "the cat sat " * 20_000, "en", "s", 1), (5, "the cat sat " * 20_000, "en", "s", 1), (None, "no id here", "en", "s", 1), (7, "naïve ☃ 日本語 \U0001f600 \u0000 x", "de", "s", 1), (8, "don't  stop\r\n\r\n  now", "fr", "s", 3), (9, "12 34 !!! ...", None, None, 2), (10, "\u0301\u0302 \u2167", "en", "s", 4), (11, "a <|endoftext|> b", "en", "s", 17)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like those the operators add."""
    clash = ["score", "spans", "lang_pred", "fingerprint", "component_id", "key", "n_pii", "_own_score", "fp", "value", "rank"]
    return spark.createDataFrame(ODD, DOCS).select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def library(name):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(df):
    return bpe.encode_documents(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()


def test_bpe_is_the_librarys(spark, docs, odd, none):
    enc = library("byte_bpe_multi_50k.tiktoken")
    for df in (docs, odd):
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        want = sorted((d or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts for ids in [enc.encode_ordinary(t)])
        got = encoded(df)
        assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want and all(r.round_trip for r in got)
    assert encoded(none) == []


def test_prefix_table_appends_and_edits():
    vocabulary = bpe.Vocabulary(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    rng = random.Random(3)
    letters = b"theaningrcous xyz"

    def text(n):
        return bytes(rng.choice(letters) for _ in range(n))

    for _ in range(40):
        data = text(rng.randint(0, 60))
        table = bpe.PrefixTable(vocabulary, data)
        for _ in range(4):
            if rng.random() < 0.5:
                more = text(rng.randint(0, 9))
                table.append(more)
                data += more
            else:
                a, b = sorted(rng.randint(0, len(data)) for _ in range(2))
                new = text(rng.randint(0, 6))
                table.edit(a, b, new)
                data = data[:a] + new + data[b:]
            assert table.last == bpe.PrefixTable(vocabulary, data).last
            assert b"".join(vocabulary.bytes_of[i] for i in table.ids()) == data


def plain_fingerprint(text):
    import xxhash

    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(prints):
    ids = [d for d, _ in prints]
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, d in enumerate(ids):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return [least.get(find(k)) for k in range(len(ids))]


def test_simhash(docs, odd, none):
    for df in (docs, odd):
        rows = df.collect()
        prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
        want = sorted((d or -1, f"{p:016x}", c or -1) for (d, p), c in zip(prints, components(prints)))
        assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_ball_hashing_finds_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for n in (1, 2, 3, 4):
            fps.append(int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)))
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    masks = simhash.flips()
    odd = np.bitwise_count(fps) & 1
    made = np.concatenate([(fps[:, None] ^ masks[None, : simhash.NEAR]).ravel(), (fps[odd == 1][:, None] ^ masks[None, simhash.NEAR :]).ravel()])
    which = np.concatenate([np.tile(np.arange(simhash.NEAR), len(fps)), np.tile(np.arange(simhash.NEAR, len(masks)), int(odd.sum()))])
    u, v = simhash.meet(made, which)
    assert (np.bitwise_count(u ^ v) <= 3).all()
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(u, v):
        root[find(int(a))] = find(int(b))
    for a in fps:
        for b in fps:
            if bin(int(a) ^ int(b)).count("1") <= 3:
                assert find(int(a)) == find(int(b))


def test_languages(spark, sf, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", F.col("text").rlike(r"\p{L}").alias("has")), "doc_id").collect()
    own = [r for r in got if r.held_out and r.lang and r.has]
    assert sum(r.lang_pred == r.lang for r in own) / len(own) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    some = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert len(langid.identify(odd).collect()) == len(ODD) and some[1].lang_pred == some[2].lang_pred == some[9].lang_pred == some[10].lang_pred == "und" and some[11].lang_pred != "und" and some[1].spans == []
    assert langid.identify(none).count() == 0


def test_mixed_text_is_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    long = {r.lang: r.text for r in docs.where("length(text) between 1500 and 4000 and lang is not null").collect()}
    mixed = spark.createDataFrame([(1, long["de"] + "\n" + long["es"])], "doc_id long, text string")
    spans = langid.label(mixed, model).first().spans
    assert [s.lang for s in spans] == ["de", "es"] and abs(spans[0].end - len(long["de"])) < 40
    assert spans[0].start == 0 and spans[-1].end == len(long["de"]) + 1 + len(long["es"])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], np.zeros((langid.BUCKETS, 3), np.float32), {}, 4.0)
    for _ in range(200):
        s = -rng.exponential(2, (3, rng.integers(1, 40))).astype(np.float32)
        best = s[:, 0].astype(float)
        for t in range(1, s.shape[1]):
            best = np.maximum(best, best.max() - 4.0) + s[:, t]
        path = model.path(s)
        path = np.full(s.shape[1], path) if isinstance(path, int) else path
        assert s[path, np.arange(s.shape[1])].sum() - 4.0 * (np.diff(path) != 0).sum() == pytest.approx(best.max(), abs=1e-4)


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").collect()
    assert len(got) > 300 and np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in got)
    other = quality.classify(odd, labels.withColumn("text", F.lit(1))).collect()
    assert len(other) == len(ODD) and all(0 <= r.score <= 1 for r in other)
    many = spark.createDataFrame([(1, "some words here.")] * 200, "doc_id long, text string")
    own = spark.createDataFrame([(1, 1)] * 40, "doc_id long, quality int")
    assert quality.classify(many, own).count() == 200 and quality.train(many, own)["curve"].shape == (2,)
    nothing = labels.limit(0)
    assert quality.classify(odd, nothing).count() == len(ODD) and quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.withColumn("quality", F.lit(None).cast("int"))).where("score between 0 and 1").count() == docs.count()


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(2)
    scores, moves = rng.standard_normal((1, 5)), rng.standard_normal((2, 2))
    total, good = 0.0, np.zeros(5)
    for code in range(32):
        s = [code >> k & 1 for k in range(5)]
        w = np.exp(sum(x * scores[0, k] for k, x in enumerate(s)) + sum(moves[a, b] for a, b in zip(s, s[1:])))
        total += w
        good += w * np.array(s)
    marginal, expected = quality.chain(scores, np.ones((1, 5), bool), moves)
    assert marginal[0] == pytest.approx(good / total) and expected.sum() == pytest.approx(4)


KEY = "a key of the tests"
TEXTS = [
    (1, "Write to ann.lee@mail.example.com or +1 (521) 555-6210, from 188.54.39.104."), (2, "again ann.lee@mail.example.com and 4111 1111 1111 1111; Mrs Ann Lee and Mr. Ann Lee"), (3, None), (4, ""), (5, "nothing here 123"), (6, "г-жа Анна Каренина, DE89 3704 0044 0532 0130 00, 123-45-6789"), (6, "г-жа Анна Каренина, DE89 3704 0044 0532 0130 00, 123-45-6789"), (None, "10.1.2.3 10.1.2.3"),
]


def test_surrogates(spark, none):
    import re

    df = spark.createDataFrame(TEXTS, "doc_id long, text string").select("*", F.lit("y").alias("_pii_key"), F.lit("z").alias("n_pii"), F.lit("k").alias("value"))
    rows = pii.replace(df, KEY).orderBy("doc_id").collect()
    got = {r.doc_id: r.text for r in rows}
    assert len(rows) == len(TEXTS) and all(r._pii_key == "y" and r.value == "k" for r in rows)
    assert got[3] is None and got[4] == "" and got[5] == "nothing here 123"
    for secret in ("ann.lee@mail.example.com", "555-6210", "188.54.39.104", "4111 1111", "Ann Lee", "Каренина", "0532 0130", "123-45-6789", "10.1.2.3"):
        assert not any(secret in (t or "") for t in got.values())
    mail = re.search(r"\S+@\S+\.com", got[1])[0]
    assert mail in got[2] and re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.com", mail)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, from \d+\.\d+\.\d+\.\d+\.$", got[1])
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", got[2])[0].replace(" ", "")
    assert sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(card))) % 10 == 0
    assert re.search(r"Mrs [A-Z][a-z]+ [A-Z][a-z]+ and Mr\. [A-Z][a-z]+ [A-Z][a-z]+$", got[2])
    assert re.search(r"^г-жа [А-Я][а-я]+ [А-Я][а-я]+, DE\d\d( \d{4}){4} \d\d, \d{3}-\d\d-\d{4}$", got[6])
    a, b = got[None].split()
    assert a == b and a.startswith("10.") and not a.startswith("10.1.2.")
    assert pii.replace(df, "other key").where("doc_id = 1").first().text != got[1] and pii.replace(none, KEY).count() == 0
    with pytest.raises(ValueError):
        pii.replace(df, "")


def test_surrogates_stay_distinct(spark):
    """Nearly all addresses of a small network: every draw collides with something."""
    df = spark.createDataFrame([(k, f"from 10.1.{k // 200 + 1}.{k % 200 + 1} on") for k in range(400)], "doc_id long, text string")
    got = [r.text for r in pii.replace(df, KEY).collect()]
    assert len(set(got)) == 400 and not set(got) & {f"from 10.1.{k // 200 + 1}.{k % 200 + 1} on" for k in range(400)}


def test_surrogates_never_run_out(spark):
    """More surnames, addresses and short mail names than there are surrogates of the usual size."""
    import re

    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["Mr " + "".join(letters[k // 26**p % 26] for p in range(4)).capitalize() for k in range(5_000)]
    hosts = [f"192.168.{k // 255}.{k % 255 + 1}" for k in range(65_000)]
    mails = [f"{a}@example.com" for a in letters] + [f"{a}{b}@example.com" for a in letters for b in letters] + [f"{a}@example.com" for a in "0123456789"]
    for values, form in ((names, r"Mr [A-Z][a-z]+"), (hosts, r"(192\.168|10\.\d+)\.\d+\.\d+"), (mails, r"[a-z0-9]+@[a-z]{7}\.com")):
        rows = pii.replace(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), KEY).collect()
        got = {r.text for r in rows}
        assert len(rows) == len(got) == len(values) and all(r.n_pii == 1 for r in rows)
        assert not got & set(values) and all(re.fullmatch(form, x) for x in got)


def test_surrogates_follow_spellings(spark):
    import re

    rows = [
        (1, "Call +1 (521) 555-6210, +15215556210, +1 521 555 6210 or (521) 555-6210. Mail Ann.Lee@x.example.com, ann.lee@x.example.com"),
        (2, "Mrs Ann Lee came. Ann Lee left with Mr Lee; Dr Ann Lee, Prof. John Smith; passport AB1234567, 4111-1111-1111-1111 4111 1111 1111 1111"),
        (3, "x\x01y Mr Jones\x01 MR JONES GB82 WEST 1234 5698 7654 32, GB82WEST12345698765432"), (4, "a@" + "b." * 100_000 + "com " + "Mr Ab, " * 3_000 + "1.2." * 50_000),
    ]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    digits = [re.sub("[^0-9]", "", x)[-10:] for x in re.match(r"Call (.*), (.*), (.*) or (.*)\. Mail", got[1].text).groups()]
    assert len(set(digits)) == 1 and digits[0] != "5215556210" and got[1].n_pii == 6
    a, b = re.search(r"Mail (\S+), (\S+)$", got[1].text).groups()
    assert a.lower() == b and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[a-z]\.[a-z]{7}\.com", a)
    given, family, john, smith, passport, c, d = re.fullmatch(r"Mrs (\w+) (\w+) came\. \1 \2 left with Mr \2; Dr \1 \2, Prof\. (\w+) (\w+); passport ([A-Z]{2}\d{7}), (4[\d-]{18}) (4[\d ]{18})", got[2].text).groups()
    assert len({given, family, john, smith, "Ann", "Lee", "John", "Smith"}) == 8 and passport != "AB1234567" and c.replace("-", " ") == d
    one, two = re.fullmatch("x\x01y Mr ([A-Z][a-z]+)\x01 MR ([A-Z]+) GB.*", got[3].text).groups()
    assert one.upper() == two != "JONES"
    x, y = re.search(r"(GB[A-Z0-9 ]+), (GB\w+)$", got[3].text).groups()
    assert x.replace(" ", "") == y and int("".join(str(int(k, 36)) for k in y[4:] + y[:4])) % 97 == 1
    assert got[4].n_pii == 3_001 and "Mr Ab," not in got[4].text and got[4].text.endswith("1.2." * 50_000)


def test_surrogates_of_the_table(spark):
    """Spans, canonical forms and one-to-one replacement by a plain version, over the whole table."""
    import re

    import regex

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pii.replace(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), KEY).collect()}
    kinds = [(k, regex.compile(p, regex.ASCII)) for k, p in pii.FORMS]
    anything = regex.compile("|".join(p for _, p in pii.FORMS), regex.ASCII)
    to: dict = {}
    for doc, text in rows:
        hits = list(anything.finditer(text or ""))
        assert got[doc].n_pii == len(hits)
        if not hits:
            assert got[doc].text == text
            continue
        gaps = [text[a:b] for a, b in zip([0, *(h.end() for h in hits)], [*(h.start() for h in hits), len(text)])]
        new = regex.fullmatch("(?s)" + "(.+?)".join(map(regex.escape, gaps)), got[doc].text).groups()
        for h, n in zip(hits, new):
            kind = next(k for k, p in kinds if p.fullmatch(h[0]))
            assert kind == "person" or next(k for k, p in kinds if p.fullmatch(n)) == kind
            plain = [re.sub("[^0-9+]", "", x) if kind in ("phone", "ssn", "card") else x.replace(" ", "") if kind == "iban" else x.lower() for x in (h[0], n)]
            assert to.setdefault((kind, plain[0]), plain[1]) == plain[1]
    assert len(to) > 50 and len(set(to.values())) == len(to) and not set(to.values()) & {v for _, v in to}


def unpacked(df, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d or -1, *t.encode(x or "", add_special_tokens=False).ids, 0) for d, x in rows)
    lengths = {}
    for w in want:
        lengths.setdefault(w[0], []).append(w[1:])
    pieces = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert any(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and len(ids) == p.doc_tokens for ids in lengths[p.doc_id or -1])
    assert sum(p.length for p in pieces) == sum(len(w) - 1 for w in want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    used = [sum(n for _, n in s) for s in sequences.values()]
    return sum(used) / sum(packing.padded(n, 1024) for n in used), pieces


def test_packing(spark, docs, odd, none):
    fill, _ = unpacked(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert fill > 0.985
    _, pieces = unpacked(odd, [(r[0], r[1]) for r in ODD])
    assert {p.doc_tokens for p in pieces if p.doc_id in (1, 2)} == {1}
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_patterns_hold_exactly_the_demand():
    rng = np.random.default_rng(4)
    for _ in range(5):
        demand = {int(x): int(rng.integers(1, 60)) for x in rng.choice(np.arange(1, 128), 30, replace=False)}
        made = {}
        for times, lengths in packing.exact_patterns(demand, 128, 4):
            assert sum(lengths) <= 128
            for x in lengths:
                made[x] = made.get(x, 0) + times
        assert made == demand


def test_fresh_names():
    assert fresh(["a", "_own_x", "_OWN__y"]) == "_own___"
