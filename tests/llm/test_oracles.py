"""Queries of the subpackage against their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from vortiq.llm import chat, embed_dedup, queries, secrets

SQL = queries.oracle_sql()
TABLE = {"op3_chat": "conversations", "op6_embeddings": "embeddings", "op8_secrets": "documents", "op12_licenses": "documents", "op13_divergence": "documents"}


def compared(df, name, path):
    con = duckdb.connect()
    con.execute(f"create view {TABLE[name]} as select * from read_parquet('{path}')")
    got = con.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str), sorted(got.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, sf, name):
    mine, theirs = compared(queries.queries()[name](spark, sf), name, f"{sf}/{TABLE[name]}.parquet")
    assert mine == theirs and len(mine) > 10


def test_secrets_of_odd_texts(spark, tmp_path):
    key = "AKIA" + "Z" * 20
    texts = [None, "", "é" * 5 + " password=abcdef", "toKen: x ToKeN = 'abc123' api_key:=zz", key + key, "0" * 24 + "x" + "f" * 23, f"secret={key}, 😀 {key}", "-----BEGIN RSA PRIVATE KEY-----\n" + "deadbeef" * 4, "bearer " + "a" * 25 + " http://me:pw@h", "ſecret=abcdefgh"]
    df = spark.createDataFrame([(k % 7, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit(1))
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    mine, theirs = compared(secrets.digest(secrets.scan(df)), "op8_secrets", tmp_path / "d" / "*.parquet")
    assert mine == theirs and len(mine) == len(texts)


def test_chat_of_odd_turns(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "<turn role=user>\n&amp;</turn>\n"), (2, None, None, "x"), (3, 5, "assistant", "é😀 & > <"), (3, 6, "sys<tem>", "a\nb")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    more = spark.createDataFrame([(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")], df.schema)
    mine, theirs = compared(chat.format_conversations(df.union(more)), "op3_chat", tmp_path / "c" / "*.parquet")
    assert mine == theirs and len(mine) == 4


def test_links_of_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.95, 0.1]), (2, [0.95, 0.1]), (3, [0.6, 0.75]), (4, [0.8, 0.55]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, [-1.0, 0.0]), (11, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    mine, theirs = compared(embed_dedup.near_duplicates(df, block_dims=1), "op6_embeddings", tmp_path / "e" / "*.parquet")
    assert mine == theirs and len(mine) == len(rows)
