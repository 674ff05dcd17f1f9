"""Byte-level BPE by prefix dynamic programming.

Of each byte prefix exactly one token can be the last one of its encoding, so one table entry per byte (the length
and id of that token) holds the encodings of all prefixes. A candidate for the last token is right if it and the
last token of the prefix before it stay apart when the merges run on just these two. Appending needs only new
entries; after an edit the table is rebuilt from there until as many entries in a row as the longest token has bytes
agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame


def load_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 tokens and ranks, one pair a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks of a byte-level BPE. max_pairs bounds the memory of pair verdicts."""

    def __init__(self, ranks: dict[bytes, int], max_pairs: int = 1_000_000):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.max_pairs = max_pairs
        #: Finds every token that ends at a byte, longest first; only those that the merges make of their own bytes,
        #: for no other can stand inside a longer string.
        self.tokens = ahocorasick.Automaton()
        for t, i in ranks.items():
            if len(self.merge(t)) == 1:
                self.tokens.add_word(t.decode("latin-1"), (len(t), i))
        self.tokens.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """The merges themselves, in order of rank, leftmost first; only for strings of one or two tokens."""
        get, none = self.ranks.get, 1 << 40
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            costs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether the two stay apart as neighbours."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= self.max_pairs:
                self._pairs.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self._pairs[left, right] = self.merge(a + b) == [a, b]
        return known


class PrefixTable:
    """Last tokens of all prefixes of one byte string; append and edit keep them exact."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, "", []
        self.append(data)

    def _extend(self, old: list[int], settled: int) -> None:
        """Entries from len(self.last) on. Stops once enough entries past settled agree with old, which then follow."""
        last, apart, longest = self.last, self.vocabulary.apart, self.vocabulary.longest
        done, moved, agreed = len(last), len(self.data) - len(old), 0
        base = max(0, done - longest)
        for at, (size, token) in self.vocabulary.tokens.iter(self.data[base:] if base else self.data):
            at += base
            if at < done or size > at + 1:
                continue
            if size == at + 1 or apart(last[at - size], token):
                if at != done:
                    break
                last.append(token)
                done += 1
                if old and at >= settled:
                    agreed = agreed + 1 if old[at - moved] == token else 0
                    if agreed >= longest:
                        last += old[done - moved :]
                        return
        if len(last) != len(self.data):
            raise ValueError(f"no token ends at byte {len(last)}; the vocabulary lacks single bytes")

    def append(self, more: bytes) -> None:
        self.data += more.decode("latin-1")
        self._extend([], 0)

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replaces data[start:stop]."""
        old, self.last = self.last, self.last[:start]
        self.data = self.data[:start] + new.decode("latin-1") + self.data[stop:]
        self._extend(old, start + len(new))

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece (each match of pattern by itself), remembering at most max_pieces pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 500_000):
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.find = regex.compile(pattern).findall
        self.max_pieces = max_pieces
        self._known: dict[str, bytes] = {}

    def piece(self, piece: bytes) -> list[int]:
        """A piece that is a token itself is that token, as in the public library."""
        whole = self.vocabulary.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self.vocabulary, piece).ids()

    def __missing_piece(self, piece: str) -> bytes:
        if len(self._known) >= self.max_pieces:
            self._known.clear()
        ids = self.piece(piece.encode())
        got = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= 64:
            self._known[piece] = got
        return got

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self._known.get
        return b"".join([known(p) or self.__missing_piece(p) for p in self.find(text)])

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I")))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids and decoded bytes of every whole text, reduced to counts and digests.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, round_trip (decoded bytes equal the text's UTF-8),
    one row for each input row, repeated ids and rows included. Null and empty texts have no tokens; a null id stays
    null; other columns of docs are ignored. One pass without a shuffle; memory is one batch of texts and the bounded
    piece cache.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = enc.encode_bytes(text)
                back, raw = enc.decode_bytes(ids), text.encode()
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), len(back), back == raw))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "round_trip"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean")
