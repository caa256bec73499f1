"""Clustering and whitening against plain Python and numpy's own eigenvectors."""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pytest

from answerrec.llm import centroids, whitening
from answerrec.llm.queries import ORACLES, QUERIES
from answerrec.llm.spectrum import count_above, leading
from oracle import compare, connect

SCHEMA = "vec_id long, embedding array<double>, cluster string, y int, vec int, n int, distance long, at int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], None, 1, 2, None, 3, 4) for i, v in rows], SCHEMA)


# clustering


def plain_clusters(rows, size, clusters=8, rounds=10, scale=1024):
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if i is not None and v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        where = assign()
        for k in range(len(centres)):
            if own := [v for (_, v), (_, j) in zip(kept, where) if j == k]:
                centres[k] = [sum(column) // len(own) for column in zip(*own)]
    where = assign()
    total = sum(d for d, _ in where)
    inertia = {k: sum(d for d, j in where if j == k) for k in range(len(centres))}
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, k, long(d), long(inertia[k]), long(total), centres[k]) for (i, _), (d, k) in zip(kept, where)), key=str)


def found_clusters(df, **options):
    out = centroids.centroid_clusters(df, **options).collect()
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in out), key=str)


def test_clusters_equal_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(connect(sf_dir), QUERIES["op12_centroids"](spark, sf_dir), ORACLES["op12_centroids"]) == []


@pytest.mark.parametrize("factor", [1.0, 0.01, 3e6])
def test_clusters_equal_brute_force(spark, factor):
    rng = np.random.default_rng(3)
    rows = [(i % 230, list(factor * rng.normal(size=5) + (i % 4))) for i in range(260)]  # some ids repeat
    rows += [(1000 + i, [0.5] * 5) for i in range(90)]  # a third are copies
    rows += [(2000, None), (2001, []), (2002, [1.0] * 4), (2003, [1.0, None, 0, 0, 0]), (2004, [float("nan")] * 5), (2005, [float("inf")] * 5), (None, [1.0] * 5)]
    assert found_clusters(frame(spark, rows).repartition(3), size=5) == plain_clusters(rows, 5)


def test_few_no_and_equal_vectors(spark):
    for rows in ([], [(4, [1.0, 2.0])], [(i, [0.25, -0.25]) for i in range(20)], [(7, [0.0, 1.0]), (7, [0.0, 1.0]), (7, [-1.0, 1.0])]):
        assert found_clusters(frame(spark, rows), size=2) == plain_clusters(rows, 2)


def test_sums_beyond_a_long_are_exact_or_null(spark):
    rows = [(i, [2.0**40 * (-1) ** i, float(i)]) for i in range(30)]
    found = found_clusters(frame(spark, rows), size=2, clusters=1)
    assert found == plain_clusters(rows, 2, clusters=1) and found[0][2:5] == (None, None, None)


# whitening


def test_counts_and_eigenpairs():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 9, 40):
        for kind in range(4):
            x = rng.normal(size=(60, size))
            x = x * [1, 0.0, 10.0, 1][kind] if kind else x
            a = x.T @ x
            if kind == 2:
                a = np.diag(np.repeat([5.0, 1.0], size)[:size])  # equal eigenvalues
            if kind == 3:
                a = a - np.trace(a) / size * np.eye(size)  # some are negative
            exact = np.sort(np.linalg.eigvalsh(a))[::-1]
            for shift in (-3.3, 0.1, 2.0, 77.7):
                assert count_above(a, shift) == (exact > shift).sum()
            values, vectors = leading(a, 7)
            scale = max(1.0, np.abs(a).max())
            assert np.abs(values - exact[:7]).max() < 1e-12 * scale
            assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-13
            assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-12 * scale


def check_whitening(rows, out, components=32, scale=64):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    size = max(len(v) for _, v in kept)
    x = [[int(np.floor(scale * float(c))) + 1_000_000 for c in [*v, *[0] * (size - len(v))]] for _, v in kept]
    n = len(x)
    sums = [sum(column) for column in zip(*x)]
    away = [[n * c - s for c, s in zip(row, sums)] for row in x]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in away), n**3)) for j in range(size)] for i in range(size)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > 1e-11 * values[0]).sum()))
    y = np.array(away, float) / n @ vectors[:, :count] / np.sqrt(values[:count])
    assert len(out) == n * count
    assert {r["n"] for r in out} == {n}
    where = sorted(range(n), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, away[i]))
    by_row = {}
    for r in out:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    assert all(abs(r["explained"] / (values[r["component"] - 1] / np.trace(cov)) - 1) < 1e-6 and r["identity_error"] < 1e-7 for r in out)
    sign = np.zeros(count)
    for i in where:
        if [k for k, _ in kept].count(kept[i][0]) > 1:
            continue
        found = by_row[kept[i][0]]
        assert sorted(found) == list(range(1, count + 1))
        exact = sum(a * a for a in away[i])
        assert found[1]["deviation"] == (exact if exact < 2**63 else None)
        theirs = np.array([found[c + 1]["whitened"] for c in range(count)])
        new = (sign == 0) & (np.abs(y[i]) > 1e-3)
        sign[new] = np.sign(theirs * y[i])[new]
        assert np.abs(theirs - sign * y[i]).max() < 1e-6 or (sign == 0).any()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6))
    rows = [(i, list(rng.normal(size=6) @ mix)) for i in range(120)]
    rows += [(500, [1.0, 2.0]), (501, []), (None, [1.0] * 6), (502, None), (503, [1.0, None, 0, 0, 0, 0]), (504, [float("nan")] * 6), (505, [float("-inf")] * 6), (3, [9.0] * 6)]
    df = frame(spark, rows).repartition(3)
    check_whitening(rows, whitening.whitened(df).collect())
    two = whitening.whitened(df, components=2).collect()
    assert len(two) == 2 * 124
    check_whitening(rows, two, components=2)


def test_whitening_of_large_entries_and_flat_directions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [*(3e6 * rng.normal(size=3)), 7.0, 0.0]) for i in range(60)]
    rows = [(i, [*v[:4], v[0]]) for i, v in rows]  # a constant and a repeated dimension
    check_whitening(rows, whitening.whitened(frame(spark, rows)).collect())
    huge = whitening.whitened(frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])])).collect()
    assert {r["deviation"] for r in huge} == {None} and all(np.isfinite(r["whitened"]) for r in huge)


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(i, [1.0, 1.0]) for i in range(9)]):
        out = whitening.whitened(frame(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(rows, QUERIES["op13_whitening"](spark, sf_dir).collect())
