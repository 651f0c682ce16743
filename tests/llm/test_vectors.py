"""Vector codes and centroid clusters against plain Python over exact integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm import centroid_clusters, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n string, dim string, codes string, cluster string, planes string, error string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)


def vectors(n, width=64, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.uniform(-spread, spread))) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]


def near(x, centroids):
    return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), sum(x * x for x in r[1])))
    cents = [v for _, v in order[:k]]
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v, cents)[1], []).append(v)
        cents = [[sum(x) // len(members[c]) for x in zip(*members[c])] if c in members else old for c, old in enumerate(cents)]
    found = [(i, *near(v, cents)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    return sorted(((i, c, d, sum(e for _, b, e in found if b == c), total, cents[c]) for i, c, d in found), key=repr)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    out = []
    whole = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for dim in {len(v) for _, v, _ in whole}:
        mine = [r for r in whole if len(r[1]) == dim]
        if dim % parts:
            out += [(i, label, None, None) for i, _, label in mine]
            continue
        width = dim // parts
        cut = lambda v, p: v[p * width : (p + 1) * width]
        first = sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
        books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
        for _ in range(rounds):
            for p in range(parts):
                members = {}
                for _, v, _ in mine:
                    members.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
                books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else old for e, old in enumerate(books[p])]
        for i, v, label in mine:
            best = [near(cut(v, p), books[p]) for p in range(parts)]
            out.append((i, label, [e for _, e in best], sum(d for d, _ in best)))
    return sorted(((*r, None if r[3] is None else sum(s[3] for s in out if s[1] == r[1] and s[3] is not None)) for r in out), key=repr)


def odd_vectors():
    rows = vectors(60)
    one = rows[0][1]
    return rows + [
        (100, None, 1), (101, [], 1), (102, [None] * 64, 1), (103, [NAN, *one[1:]], 1), (104, [INF, *one[1:]], 1), (105, one[:63], 2), (106, [0.0] * 64, 1),
        (None, one, None), (None, rows[1][1], 0), (3, rows[3][1], rows[3][2]), (3, rows[4][1], 0), (107, [x * 300 for x in one], 1),
    ] + vectors(30, 16, 2)


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(3)
    for reach in (1, 64, 70_000, 1 << 27):
        a, b = rng.integers(-reach, reach + 1, (40, 64)), rng.integers(-(reach // 3) - 1, reach, (7, 64))
        pa_, pb = centroid_clusters.planes_of(a), centroid_clusters.planes_of(b)
        assert (centroid_clusters.dots(pa_, pb) == a @ b.T).all()
        assert (centroid_clusters.squared_lengths(pa_) == (a * a).sum(axis=1)).all()
        assert (centroid_clusters.member_sums(pa_, np.arange(40) % 7, 7) == [a[k::7].sum(axis=0) for k in range(7)]).all()
    assert (centroid_clusters.planes_of(np.array([[-1] + [0] * 63])) == [[1]]).all()


@pytest.mark.parametrize("rows", [odd_vectors(), vectors(5), [(9, [0.5] * 64, None)] * 3, []])
def test_clusters_as_in_plain_python(spark, rows):
    got = centroid_clusters.cluster_vectors(table(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_clusters(rows)


@pytest.mark.parametrize("rows", [odd_vectors(), vectors(5, 24), [(9, [0.5] * 64, None)] * 3, []])
def test_codes_as_in_plain_python(spark, rows, monkeypatch):
    codes, books = vector_codes.compress_vectors(table(spark, rows).repartition(3))
    got = vector_codes.with_label_errors(codes).select("id", codes.label.cast("int"), "codes", "error", "label_error").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(rows)
    assert {r.dim for r in books.collect()} == {len(v) for i, v, _ in rows if v is not None and len(v) % 8 == 0 and all(x is not None and math.isfinite(x) for x in v)}


def test_many_blocks_agree_with_one(spark, monkeypatch):
    rows = table(spark, vectors(300))
    one, _ = vector_codes.compress_vectors(rows.coalesce(1))
    many, _ = vector_codes.compress_vectors(rows.repartition(7))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))


def test_numbers_beyond_a_long_are_an_error(spark):
    rows = table(spark, [(1, [1e30] * 64, 0)])
    for run in (centroid_clusters.cluster_vectors, vector_codes.compress_vectors):
        with pytest.raises(Exception, match="do not fit 64 bits"):
            run(rows)
