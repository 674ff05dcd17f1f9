"""Alignment of two tokenizers over the same bytes.

The ends of both tokenizations cut a text's bytes into elementary intervals: the union of both end arrays, each
interval owned by one token of either side, found by binary search. An interval is one overlap of two tokens; where
both sides end, a group closes. Tokens of both sides whose ranges stand in the asked relation are linked.

Texts are handled in blocks of bounded bytes, and a block keeps its distinct linked id pairs once with their number:
corpus-wide counts are summed from these, and go back to blocks, not to single texts. Rows are texts and pairs, never
blocks, so that what executors hold does not follow the block's size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .packing import byte_letters, encoding

#: Bytes of text in a block; one text at least.
BLOCK_BYTES = 1 << 19
#: What links two tokens: a common end, a common byte, or a common group.
RELATIONS = ("end", "overlap", "group")


class Pair:
    """Both tokenizers with the bytes of their tokens, one a worker process."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        import sentencepiece

        self.a, self.b = encoding(path_a, pattern), sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec.get("added_tokens", [])}
        vocabulary = spec["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))]
        self.length_a, self.length_b = (np.array([len(t) for t in ts], np.int64) for ts in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        #: Decimal ids with what may follow them, for the text of groups.
        self.shown = [f"{i}{end}" for end in ",|;" for i in range(most)]
        self.most = most

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for a text that is empty or that the tokens of either side don't spell."""
        ids_a, ids_b = [], []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a = self.a.encode_ordinary(" " + text) if text else []
            raw = b" " + text.encode()
            if not text or b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                a = b = []
            ids_a.append(a)
            ids_b.append(b)
        return ids_a, ids_b


_PAIRS: dict[tuple, Pair] = {}


def pair(*paths: str) -> Pair:
    if paths not in _PAIRS:
        _PAIRS[paths] = Pair(*paths)
    return _PAIRS[paths]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... count[k] numbers for each k, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """union1d of two rising arrays, without hashing."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.append(both[1:] != both[:-1], True)] if len(both) else both


class Block:
    """Aligned tokens of several texts, end to end. Numbers of tokens are places in ids_a and ids_b.

    Every token has a byte at least. ends: of the elementary intervals; owner_a and owner_b: the tokens that own them;
    shared: intervals at whose end both tokens end; closed: these ends, each of which closes a group; of_a and of_b:
    number of tokens up to each text's end.
    """

    def __init__(self, ids_a: list[list[int]], ids_b: list[list[int]], length_a: np.ndarray, length_b: np.ndarray):
        flat = lambda ids: np.concatenate([np.array(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
        upto = lambda ids: np.cumsum([len(x) for x in ids], dtype=np.int64)
        self.ids_a, self.ids_b, self.of_a, self.of_b = flat(ids_a), flat(ids_b), upto(ids_a), upto(ids_b)
        self.ends_a, self.ends_b = np.cumsum(length_a[self.ids_a], dtype=np.int64), np.cumsum(length_b[self.ids_b], dtype=np.int64)
        self.ends = union(self.ends_a, self.ends_b)
        self.owner_a, self.owner_b = np.searchsorted(self.ends_a, self.ends), np.searchsorted(self.ends_b, self.ends)
        self.shared = (self.ends_a[self.owner_a] == self.ends) & (self.ends_b[self.owner_b] == self.ends)
        self.closed = self.ends[self.shared]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of every token of both sides."""
        return np.searchsorted(self.closed, self.ends_a), np.searchsorted(self.closed, self.ends_b)

    def links(self, relation: str) -> tuple[np.ndarray, np.ndarray]:
        """Linked tokens of both sides, by place."""
        if relation == "overlap":
            return self.owner_a, self.owner_b
        if relation == "end":
            return self.owner_a[self.shared], self.owner_b[self.shared]
        # the product of the group's members of both sides
        (from_a, to_a), (from_b, to_b) = ((cut[:-1], cut[1:]) for cut in self.cuts())
        n_a, n_b = to_a - from_a, to_b - from_b
        each = np.repeat(n_b, n_a)
        return np.repeat(ranges(from_a, n_a), each), ranges(np.repeat(from_b, n_a), each)

    def cuts(self) -> list[np.ndarray]:
        """First tokens of every group of both sides, and the number of tokens."""
        return [np.searchsorted(g, np.arange(len(self.closed) + 1)) for g in self.groups()]

    def shown(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of `a1,a2|b1;a3|b2` in reading order (id, with most added before '|' and twice before ';'), and the
        number of codes up to each text's end."""
        group_a, group_b = self.groups()
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        codes = np.empty(len(group_a) + len(group_b), np.int32)
        codes[np.arange(len(group_a)) + np.searchsorted(group_b, group_a, "left")] = self.ids_a + most * last(group_a)
        codes[np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")] = self.ids_b + 2 * most * last(group_b)
        return codes, self.of_a + self.of_b


def counted(before: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How many of the rising places lie within each text, given the texts' last places."""
    return np.diff(np.searchsorted(before, upto, "left"), prepend=0)


def blocks_of(batches: Iterable[pa.RecordBatch], bytes_of_block: int) -> Iterator[tuple[list, list[str]]]:
    """Rows (id, text) of batches, cut into blocks by the bytes of their texts."""
    docs, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            docs.append(doc)
            texts.append(text)
            held += len(text) + 64
            if held >= bytes_of_block:
                yield docs, texts
                docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


BLOCK = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, which binary, pos int, code long, times long"


def width(pairs: int) -> str:
    """The numbers that say which of so many pairs a link is."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


def aligned_blocks(docs: DataFrame, paths: tuple[str, str, str], relation: str, bytes_of_block: int = BLOCK_BYTES) -> DataFrame:
    """One row a text, with its numbers and digest and for every link which of its block's pairs it is (bytes, see
    width()); and one row for each distinct linked id pair of a block, by which code is not null: its place, the code
    (a << 32 | b, rising) and the number of its links. No row holds a whole block: Parquet's writers and readers, like
    shuffles, hold many rows at once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = pair(*paths), TaskContext.get().partitionId()
        kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
        schema = pa.schema([(c, kinds[kind]) for c, kind in (f.split() for f in BLOCK.split(", "))])
        for nth, (ids, texts) in enumerate(blocks_of(batches, bytes_of_block)):
            block = Block(*both.encode(texts), both.length_a, both.length_b)
            # a text's last byte: where its tokens end; texts without tokens end where the one before did
            last = np.append(0, block.ends_a)[block.of_a] if len(texts) else block.of_a
            at_a, at_b = block.links(relation)
            codes, which, times = np.unique(block.ids_a[at_a].astype(np.int64) << 32 | block.ids_b[at_b], return_inverse=True, return_counts=True)
            shown, upto = block.shown(both.most)
            told, start = [], 0
            for stop in upto.tolist():
                told.append(hashlib.sha256("".join(map(both.shown.__getitem__, shown[start:stop].tolist()))[:-1].encode()).hexdigest() if stop > start else "")
                start = stop
            n_links, which = counted(at_a, block.of_a), which.ravel().astype(width(len(codes)))
            cut = pa.py_buffer(np.append(0, np.cumsum(n_links) * which.itemsize).astype(np.int32))
            of_texts = [ids, np.diff(block.of_a, prepend=0), np.diff(block.of_b, prepend=0), counted(block.closed, last + 1), n_links, told, pa.Array.from_buffers(pa.binary(), len(ids), [None, cut, pa.py_buffer(which)])]
            of_pairs = [np.arange(len(codes)), codes, times]
            rows = [np.full(len(ids) + len(codes), (part << 33) + nth), *of_texts, *of_pairs]
            kept = [pa.array(x, f.type) for x, f in zip(rows, schema)]
            kept[1:8] = [pa.concat_arrays([x, pa.nulls(len(codes), x.type)]) for x in kept[1:8]]
            kept[8:] = [pa.concat_arrays([pa.nulls(len(ids), x.type), x]) for x in kept[8:]]
            yield pa.RecordBatch.from_arrays(kept, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, links, best): links of an id pair in the corpus, and whether no pair with the same id of b has more."""
    sums = blocks.where("code is not null").groupBy("code").agg(F.sum("times").alias("links"))
    # at most as many rows a window as the vocabulary of a has tokens
    of_b = Window.partitionBy(F.col("code").bitwiseAND(F.lit((1 << 32) - 1)))
    return sums.select("code", "links", (F.col("links") == F.max("links").over(of_b)).alias("best"))


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def digest(docs: DataFrame, path_a: str, pattern: str, path_b: str, relation: str = "end") -> DataFrame:
    """Per row of docs: tokens of both sides, groups, links, links whose id pair is the most frequent one of its id of b
    (n_best, ties included), the sum of the links' corpus-wide counts, and the digest of the groups' ids.

    path_a is a byte-level BPE in the tokenizers library's JSON, path_b a sentencepiece model; strings of special
    tokens are plain text to both. Null and empty texts, and those that the tokens of either side don't spell exactly,
    have no tokens: zeros and an empty digest. Rows of equal id or text each get their own row and count each; a null
    id stays null; other columns are ignored; an empty table gives an empty result. Memory is one block of texts, or
    the longest text.
    """
    if relation not in RELATIONS:
        raise ValueError(f"relation is one of {RELATIONS}")
    blocks = materialize(aligned_blocks(docs, (path_a, pattern, path_b), relation), "aligned")
    counts = materialize(pair_counts(blocks), "pairs")
    asked = blocks.where("code is not null").select(F.col("block").alias("of"), "pos", "code")
    # a frequent pair is asked for once a block: a plain join, which adaptive execution splits where a pair is hot
    answers = asked.join(counts, "code").select("of", "pos", "links", "best")
    own = blocks.where("code is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "which")

    def put(rows: pa.Table, found: pa.Table) -> pa.Table:
        n = found.num_rows
        links, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = found.column("pos").to_numpy()
        links[at], best[at] = found.column("links").to_numpy(), found.column("best").to_numpy()
        which = np.frombuffer(b"".join(rows.column("which").to_pylist()), width(n))
        upto = np.append(0, np.cumsum(rows.column("n_links").to_numpy()))
        summed = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x[which]))[upto]))
        sums = {"n_best": summed(best), "count_sum": summed(links)}
        return pa.table([sums[c] if c in sums else rows.column(c) for c in names], schema=schema)

    names = [c.split()[0] for c in DIGEST.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in names])
    return own.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(put, DIGEST)


GROUPS = "doc_id long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>"


def groups(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """The alignment itself: per row of docs its groups in order, with byte ranges of ' ' + text and the ids of both
    sides. Texts without tokens have none. One pass without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, pattern, path_b)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for ids, texts in blocks_of(batches, BLOCK_BYTES):
            out = []
            for a, b in zip(*both.encode(texts)):
                one = Block([a], [b], both.length_a, both.length_b)
                closed = one.closed
                cut = [c.tolist() for c in one.cuts()]
                out.append([{"start": s, "end": e, "a": a[cut[0][k] : cut[0][k + 1]], "b": b[cut[1][k] : cut[1][k + 1]]} for k, (s, e) in enumerate(zip([0, *closed.tolist()], closed.tolist()))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, GROUPS)
