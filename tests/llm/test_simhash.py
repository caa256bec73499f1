"""SimHash groups against fingerprints and links computed one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from answerrec.llm import simhash
from answerrec.llm.neardup import groups
from answerrec.llm.queries import QUERIES


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps, apart=3):
    """The index of the first fingerprint of each one's group."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= apart:
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", None, "x", "one Two", "a b c d A b C", " \t a\x0bb\x0c c\r\n", "ÉÉ é İ x y", "\x1c a b\x85c", "a b " * 40_000]
    texts += [" ".join(rng.choices("abcdefg", k=rng.randint(1, 60))) for _ in range(200)]
    found = simhash.fingerprints([(t or "").encode() for t in texts])
    assert found.tolist() == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints([]).tolist() == []


def test_no_reference_tells_close_fingerprints_apart_and_most_others_are_discarded():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 2000).astype(np.uint64)
    near = x.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    for y, least, most in ((near, 1, 1), (np.roll(x, 1), 0, 0)):
        p = np.arange(2000)
        table = simhash.distances(np.concatenate((x, y)), simhash.WALSH).astype(np.int8)
        gap = np.abs(table[p] - table[p + 2000]).max(axis=1)
        assert least <= (gap <= 3).mean() <= most
        flags = simhash.agreement(x) == simhash.agreement(y)
        assert least <= np.mean([[f[b].all() for b in simhash.first_blocks(3)] for f in flags], axis=0).max() or least


@pytest.mark.parametrize("crowd", [4096, 40, 7])
def test_links_join_all_that_is_near_whatever_the_crowd(spark, crowd):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)} | {0}
    for size in (2, 3, 150, 150):
        centre = rng.getrandbits(64)
        for _ in range(size):
            fp = centre
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6])):
                fp ^= 1 << bit
            fps.add(fp)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    found = simhash.linked(spark.createDataFrame([(s,) for s in signed], "fp long"), crowd=crowd)
    assert found.count() <= 16 * crowd * len(fps)
    label = {r["id"]: r["class"] for r in groups(found).collect()}
    expected = plain_classes(fps)
    ours = [label.get(s, s) for s in signed]
    pairs = {(o, e) for o, e in zip(ours, expected)}
    assert len(pairs) == len(set(ours)) == len(set(expected))


def test_groups_equal_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    expected = {(r["doc_id"], f"{fp:016x}", rows[c]["doc_id"]) for r, fp, c in zip(rows, fps, plain_classes(fps))}
    assert {tuple(r) for r in QUERIES["op11_simhash"](spark, sf_dir).collect()} == expected


def test_odd_rows(spark):
    schema = "doc_id long, text string, fp long, first string, class int, component_id long"
    texts = [(5, "one two three four"), (5, "something else than that"), (3, "something else than that"), (9, None), (8, ""), (None, " \n"), (4, "one two three four"), (4, "one two three four"), (None, "alone here without id"), (7, "w " * 300_000)]
    out = simhash.simhash_duplicates(spark.createDataFrame([(i, t, 1, "x", None, 0) for i, t in texts], schema))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 10
    found = {(r["doc_id"], r["fingerprint"] == "0" * 16): r["component_id"] for r in out.collect()}
    assert found == {(5, False): 3, (3, False): 3, (4, False): 3, (9, True): 8, (8, True): 8, (None, True): 8, (None, False): None, (7, False): 7}
    none = simhash.simhash_duplicates(spark.createDataFrame([], schema))
    assert none.count() == 0 and none.columns == out.columns
    only_null = simhash.simhash_duplicates(spark.createDataFrame([(None, None)], "doc_id long, text string"))
    assert only_null.select(F.col("component_id").isNull()).first()[0]
