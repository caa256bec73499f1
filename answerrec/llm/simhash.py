"""Near duplicates by SimHash fingerprints that meet through tables of distances to references.

Every fingerprint gets a row of Hamming distances to 128 fixed reference fingerprints: the
zero word, the 64 words of a single bit, and 63 Walsh words. Distances obey the triangle
inequality, so two fingerprints that differ in at most `apart` bits differ by at most that in
every coordinate of their rows; a pair with a larger difference anywhere is discarded, and
what survives is verified bit by bit.

The same table tells which rows need to be held against each other at all. The distances to
the words of one bit, compared with that to the zero word, depend on that bit alone. Of four
blocks of references at least one is untouched by three differences, so all pairs meet
among the rows that agree in the distances of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerrec.llm.base import byte_slices, checkpoint
from answerrec.llm.neardup import groups

WORDS = 3
SEED = 42
APART = 3
SHINGLES_AT_ONCE = 2**15
CROWD = 4_096  # rows of a bucket that are compared in one place; larger ones are dealt again
ROWS_AT_ONCE = 32  # of a large bucket, against all others
SMALL = 32  # buckets up to this size are compared many at a time


# fingerprints


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, some at a time."""
    words = text.lower().split()  # of bytes: A-Z alone are lowered, and white space is that of ASCII
    if not words:
        return
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < WORDS:
        yield np.array([digest(join(words), SEED)], np.uint64)
        return
    for at in range(0, len(words) - WORDS + 1, SHINGLES_AT_ONCE):
        some = words[at : at + SHINGLES_AT_ONCE + WORDS - 1]
        yield np.array([digest(s, SEED) for s in map(join, zip(*(some[i:] for i in range(WORDS))))], np.uint64)


def majority(ones: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Fingerprints whose bits are set where more than half of the hashes have them set."""
    bits = (2 * ones > number[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One 64-bit fingerprint per text; zero for a text without words."""
    ones, number = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def count() -> None:
        if held:
            sizes = np.array([len(h) for h in held])
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0, dtype=np.int64)
            np.add.at(ones, owners, sums)
            np.add.at(number, owners, sizes)
            held.clear()
            owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text):
            held.append(hashes)
            owners.append(i)
            waiting += len(hashes)
            if waiting >= SHINGLES_AT_ONCE:
                count()
                waiting = 0
    count()
    return majority(ones, number)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row, the fingerprint as a long; texts are read some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in byte_slices(batch, 1):
                found = fingerprints([x or b"" for x in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, fp long")


# the table of distances


def walsh_words() -> np.ndarray:
    """The 63 words of 64 bits whose bit i is the parity of i & j, for j from 1 on."""
    i = np.arange(64)
    bits = np.bitwise_count(i[None, :] & i[1:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


ZERO = np.zeros(1, np.uint64)
SINGLE = np.uint64(1) << np.arange(64, dtype=np.uint64)
WALSH = walsh_words()


def distances(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The Hamming distance of each fingerprint to each reference, as bytes."""
    return np.bitwise_count(fps[:, None] ^ references[None, :])


def agreement(fps: np.ndarray) -> np.ndarray:
    """A row of 64 flags: whether the word of that single bit is nearer than the zero word."""
    return distances(fps, SINGLE) < distances(fps, ZERO)


def block_keys(flags: np.ndarray, blocks: list[list[int]]) -> np.ndarray:
    """For each row and block, the flags of the block as a number."""
    return np.stack([flags[:, b] @ (np.int64(1) << np.arange(len(b))) for b in blocks], axis=1)


def cut(places: list[int], count: int) -> list[list[int]]:
    """Places in `count` runs of nearly equal length."""
    edges = [len(places) * i // count for i in range(count + 1)]
    return [places[a:b] for a, b in zip(edges, edges[1:])]


def first_blocks(apart: int) -> list[list[int]]:
    return cut(list(range(64)), apart + 1)


def second_blocks(block: list[int], apart: int) -> list[list[int]]:
    """Blocks of the places outside a block: pairs that agree in it have all their differences there."""
    return cut([i for i in range(64) if i not in set(block)], apart + 1)


# pairs in buckets


def unite(roots: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The roots after p and q are joined pair by pair; a root is the smallest position of its set."""
    while len(p):
        a, b = roots[p], roots[q]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := roots[roots], roots):
            roots = further
        apart = roots[p] != roots[q]
        p, q = p[apart], q[apart]
    return roots


def survivors(fps: np.ndarray, table: np.ndarray, p: np.ndarray, q: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no coordinate of the table discards and that differ in at most `apart` bits."""
    for columns in (slice(0, 4), slice(4, None)):
        gap = np.abs(table[p, columns] - table[q, columns]).max(axis=1)
        near = gap <= apart
        p, q = p[near], q[near]
    close = np.bitwise_count(fps[p] ^ fps[q]) <= apart
    return p[close], q[close]


def forest(bucket: np.ndarray, fps: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked inside each bucket, at most one per row.

    `bucket` is sorted. All pairs of a bucket are considered unless they are joined already.
    """
    table = distances(fps, WALSH).astype(np.int8)
    roots = np.arange(len(fps))
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(fps) else np.zeros(1, int)
    sizes = np.diff(edges)
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=0)))):
        p = np.flatnonzero((bucket[:-step] == bucket[step:]) & small[:-step])
        p = p[roots[p] != roots[p + step]]
        roots = unite(roots, *survivors(fps, table, p, p + step, apart))
    for start, end in zip(edges[:-1][sizes > SMALL], edges[1:][sizes > SMALL]):
        for row in range(start, end, ROWS_AT_ONCE):
            rows, others = slice(row, min(row + ROWS_AT_ONCE, end)), slice(row, end)
            mask = roots[rows, None] != roots[None, others]
            for c in range(4):
                mask &= np.abs(table[rows, None, c] - table[None, others, c]) <= apart
            p, q = np.nonzero(mask)
            roots = unite(roots, *survivors(fps, table, p + row, q + row, apart))
    moved = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[moved], fps[roots[moved]]


def links(rows: DataFrame, apart: int) -> DataFrame:
    """Links (a, b) inside the buckets of (bucket, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bucket, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = forest(bucket, fp.view(np.uint64), apart)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held_bucket = np.concatenate((held_bucket, batch.column(0).to_numpy(zero_copy_only=False)))
            held_fp = np.concatenate((held_fp, batch.column(1).to_numpy(zero_copy_only=False)))
            if not len(held_bucket):
                continue
            last = int(np.searchsorted(held_bucket, held_bucket[-1]))  # the last bucket may go on in the next batch
            if last:
                yield found(held_bucket[:last], held_fp[:last])
                held_bucket, held_fp = held_bucket[last:], held_fp[last:]
        if len(held_bucket):
            yield found(held_bucket, held_fp)

    together = rows.repartition("bucket").sortWithinPartitions("bucket")
    return together.select("bucket", "fp").mapInArrow(run, "a long, b long")


def first_keys(nodes: DataFrame, apart: int) -> DataFrame:
    """(block, key, fp): every fingerprint once per block."""
    blocks = first_blocks(apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys = block_keys(agreement(fps.view(np.uint64)), blocks)
            for b in range(len(blocks)):
                block = np.full(len(fps), b, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(keys[:, b]), pa.array(fps)], names=["block", "key", "fp"])

    return nodes.select("fp").mapInArrow(run, "block int, key long, fp long")


def second_keys(crowded: DataFrame, apart: int) -> DataFrame:
    """(block, key, run, key2, fp) of the rows of crowded buckets: once per run of the other references."""
    runs = [second_blocks(b, apart) for b in first_blocks(apart)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, key, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            flags = agreement(fps.view(np.uint64))
            for b, places in enumerate(runs):
                own = np.flatnonzero(block == b)
                keys = block_keys(flags[own], places)
                for r in range(len(places)):
                    columns = [block[own], key[own], np.full(len(own), r, np.int32), keys[:, r], fps[own]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "key", "run", "key2", "fp"])

    return crowded.select("block", "key", "fp").mapInArrow(run, "block int, key long, run int, key2 long, fp long")


def linked(nodes: DataFrame, apart: int = APART, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between fingerprints, enough to join all that differ in at most `apart` bits.

    `nodes` holds distinct fingerprints `fp`. No link is lost: a pair within reach agrees in a
    block of the table; in a bucket of more than `crowd` rows it agrees in a second block as
    well; and what is still crowded then is dealt into parts, every two of which meet in a
    place of their own. Every place gives at most one link per row.
    """
    def crowded(rows: DataFrame, *by: str) -> DataFrame:
        return checkpoint(rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > crowd))

    first, by = checkpoint(first_keys(nodes, apart)), ["block", "key"]
    large = crowded(first, *by)
    easy = first.join(large, by, "left_anti").select(F.xxhash64(*by).alias("bucket"), "fp")
    second, by = checkpoint(second_keys(first.join(large, by, "left_semi"), apart)), [*by, "run", "key2"]
    large = crowded(second, *by)
    easier = second.join(large, by, "left_anti").select(F.xxhash64(*by).alias("bucket"), "fp")
    rest = second.join(large, by).withColumn("parts", F.ceil(F.col("n") / F.lit(crowd)).cast("int"))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own"))
    rest = rest.select(*by, "fp", "own", F.explode(others).alias("other"))
    dealt = rest.select(F.xxhash64(*by, F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp")
    return links(easy.unionByName(easier).unionByName(dealt), apart).distinct()


def simhash_duplicates(docs: DataFrame, apart: int = APART) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row of `docs`.

    A fingerprint (16 hex digits) is the bitwise majority of XXH64 (seed 42) over the
    three-word shingles of a text, repeats included, with A-Z lowered; a bit is set if more
    than half of the hashes have it. A text of one or two words is one shingle; a text without
    words, or null, has the fingerprint zero, which links like any other. Fingerprints link at
    `apart` or fewer differing bits (up to 15), and rows of one doc_id belong together.
    `component_id` is the smallest doc_id reachable. Rows without doc_id link as others do;
    their component is null only if it holds no id at all. Repeated rows are repeated, an
    empty table gives an empty one, and other columns play no part.

    Texts are not shuffled. Equal fingerprints are one node, so copies, however many, cost a
    row each in a map-side sum and in the last join, which adaptive execution splits.
    """
    sketches = checkpoint(sketch(docs))
    nodes = checkpoint(sketches.groupBy("fp").agg(F.min("doc_id").alias("first")))
    of_doc = sketches.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("z")).where("b < z")
    own = sketches.join(of_doc, "doc_id").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    classes = groups(linked(nodes, apart).unionByName(own))
    named = nodes.join(classes, nodes["fp"] == classes["id"], "left").select("fp", "first", F.coalesce("class", "fp").alias("class"))
    least = named.groupBy("class").agg(F.min("first").alias("component_id"))
    # cut here: adaptive execution splits a hot fingerprint only if both sides of the join are plain shuffles
    of_fp = checkpoint(named.join(least, "class").select("fp", "component_id"))
    return sketches.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
