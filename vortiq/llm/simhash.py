"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius of 3 meet at a third one between them. Parity tells who goes how far: of a pair at
an odd distance one fingerprint has odd parity and the other even. Every fingerprint emits itself and all variants at
distance 1; those of odd parity also emit variants at distance 2. So a pair at distance 1 or 3 meets at 1 + 0 or
2 + 1 flips, and one at distance 2 at 1 + 1. Of three differing bits two lie in the same half of the 64, so the
variants at distance 2 that flip bits of one half are enough. A variant then links without comparing all pairs: a
fingerprint at most 1 away is within 3 of every other one there, and where all are 2 away any link shows elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, connected_components, discard, fresh, materialize

RADIUS, SEED = 3, 42
#: Variants that one bucket holds on average, at most.
BUCKET = 1 << 20


def flips() -> np.ndarray:
    """What a fingerprint is xored with: nothing, one bit, two bits of one half; by number of bits."""
    one = [1 << i for i in range(64)]
    two = [1 << i | 1 << j for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    return np.array([0, *one, *two], dtype=np.uint64)


NEAR = 65  # of flips(): those of at most one bit


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bits set in over half the XXH64 values of the word shingles; A-Z are lower-cased, words end at ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(s, SEED) for s in shingles), dtype="<u8", count=max(1, len(words) - width + 1))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fingerprint (fp, the 64 bits as a signed long) of every row; one pass without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


#: Mixing of variants before they are dealt: multiplication by an odd number can be undone.
MIX = 0x9E3779B97F4A7C15
UNMIX = pow(MIX, -1, 1 << 64)
#: Bits that number flips(), and so the least that a variant's place among the parts must take off its other bits.
FLIP_BITS = 11


def variants(distinct: DataFrame, group_bits: int, batch: int = 2048) -> DataFrame:
    """Rows (bucket, part, packed): the variants of many fingerprints, dealt by a hash of the variant.

    The hash can be undone; its first bits are the part, of which the first group_bits are the bucket, and the rest
    share 64 bits with the number of the flips. So a shuffle moves 8 bytes a variant.
    """
    masks = flips()
    number = np.arange(len(masks), dtype=np.uint64)
    bits = max(group_bits, FLIP_BITS)
    rest, down = np.uint64((1 << (64 - bits)) - 1), np.uint64(FLIP_BITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = rows.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(fps), batch):
                own = fps[start : start + batch]
                odd = own[(np.bitwise_count(own) & 1).astype(bool)]
                made = np.concatenate([(own[:, None] ^ masks[None, :NEAR]).ravel(), (odd[:, None] ^ masks[None, NEAR:]).ravel()]) * np.uint64(MIX)
                which = np.concatenate([np.tile(number[:NEAR], len(own)), np.tile(number[NEAR:], len(odd))])
                part = (made >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
                order = np.argsort(part, kind="stable")
                part, packed = part[order], (((made & rest) << down) | which)[order]
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                ids = part[first].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids >> (bits - group_bits)), pa.array(ids), pa.array([packed[a:b].tobytes() for a, b in zip(first, [*first[1:], len(part)])], pa.binary())], names=["bucket", "part", "packed"])

    return distinct.select("fp").mapInArrow(run, "bucket long, part long, packed binary")


def unpacked(group: pa.Table, group_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants and flips of rows of variants()."""
    bits = max(group_bits, FLIP_BITS)
    lists = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("packed")]
    packed = np.concatenate(lists)
    part = np.repeat(group.column("part").to_numpy().astype(np.uint64), [len(x) for x in lists])
    mixed = (part << np.uint64(64 - bits)) | (packed >> np.uint64(FLIP_BITS))
    return mixed * np.uint64(UNMIX), (packed & np.uint64((1 << FLIP_BITS) - 1)).astype(np.uint16)


def meet(made: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) between fingerprints that meet at a variant, each within the radius; at most one a row."""
    masks = flips()
    order = np.argsort(made, kind="stable")
    made, which = made[order], which[order]
    same = made[1:] == made[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    made, which = made[shared], which[shared]
    if not len(made):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    fps = made ^ masks[which]
    order = np.lexsort((fps, which >= NEAR, made))
    made, which, fps = made[order], which[order], fps[order]
    first = np.r_[True, made[1:] != made[:-1]]
    centre = np.flatnonzero(first)[np.cumsum(first) - 1]
    u, v = fps[centre], fps
    right = (which[centre] < NEAR) & (u != v) & (np.bitwise_count(u ^ v) <= RADIUS)
    links = np.unique(np.stack([u[right], v[right]], axis=1), axis=0)
    return links[:, 0], links[:, 1]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that keep all those within the radius connected."""
    total = distinct.count()
    bits = max(6, (total * 561 // BUCKET).bit_length())

    def run(group: pa.Table) -> pa.Table:
        u, v = meet(*unpacked(group, bits))
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return variants(distinct, bits).groupBy("bucket").applyInArrow(run, "u long, v long").distinct()


def components(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of prints (doc_id, fp); root is a fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = connected_components(links(distinct)).select(F.col("node").alias("fp"), "root")
    placed = materialize(distinct.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    discard(distinct)
    return placed.select("fp", "root").join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def one_each(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of each component: that of smallest doc_id, with all its columns; see near_duplicates().

    Where rows share that id within a component, any one of them stays, and so it is where a component has no id.
    Only rows whose id is null or repeated need their fingerprint again, to tell their component from their id's. The ids
    grow with the corpus, so they are joined by sorting at every size and never broadcast.
    """
    prints = materialize(fingerprints(docs, width), "fingerprints")
    named = materialize(components(prints), "named")
    least = prints.join(named, "fp").where("doc_id = component_id").groupBy("doc_id").agg(F.lit(True).alias("least"))
    ids = materialize(prints.where("doc_id is not null").groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("repeated")).join(least, "doc_id", "left").where("least or repeated"), "ids")
    alone = docs.join(ids.where("least and not repeated").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    unsure = docs.join(ids.where("repeated").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    own = fresh(docs.columns, "dup")
    fp, root, first = own + "fp", own + "root", own + "first"

    def work():
        return lambda texts: [pa.array(np.fromiter((fingerprint(t, width) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64))]

    printed = annotate(unsure, tuple(docs.columns), "fp long", work, own)
    placed = printed.join(named.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(first)), fp)
    return alone.union(placed.where(F.col("doc_id").eqNullSafe(F.col(first))).dropDuplicates([root]).select(*docs.columns))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """Fingerprint and component of every document.

    Returns doc_id, fingerprint (16 lowercase hex digits) and component_id: the smallest doc_id that links of at most
    3 differing bits reach, itself included. A null text and one without words have fingerprint zero, which links
    like any other. Repeated rows stay and share their component; a null doc_id never names a component unless it has
    no other id. An empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width), "fingerprints")
    named = components(prints).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
