"""Vectors, shingle sets and repeated passages against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from odd_rows import make_docs
from pyspark.sql import functions as F

from millrace.llm import components, embedding_pairs, jaccard_join, queries, suffix_dedup


class Roots(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(600)]
    links += [(5, 5), (7, 6), (7, 6), (None, 3), (3, None)]
    roots = Roots()
    for a, b in links:
        if a is not None and b is not None and a != b:
            roots.join(a, b)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(7))
    assert {r.node: r.component for r in got.collect()} == {x: roots.find(x) for x in list(roots)} and got.count() == len(roots)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- vectors

def vectors_by_hand(rows, threshold):
    ok = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    size = Counter(len(v) for _, _, v in ok).most_common(1)[0][0] if ok else 0
    ok = [x for x in ok if len(x[2]) == size]
    links, roots = Counter(), Roots()
    for n, (k, i, v) in enumerate(ok):
        for m, j, w in ok[:n]:
            if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links[k] += 1
                links[m] += 1
                roots.join(i, j)
    return Counter((i, links[k], roots.find(i) if i is not None else None) for k, (i, _) in enumerate(rows))


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] * (1 + i % 3) + rng.normal(size=16) * 0.05 * (i % 7)).tolist()) for i in range(600)]
    rows += [(1000 + i, base[0].tolist()) for i in range(5)] + [(1000, base[0].tolist()), (None, base[0].tolist()), (1001, base[3].tolist())]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0, 2.0]), (2005, []), (2006, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS label", "1 AS key", "2 AS node")
    monkeypatch.setattr(embedding_pairs, "TILE", 50)  # many tiles
    got = embedding_pairs.near_duplicates(df)
    mine = Counter((r.id, r.n_links, r.component_id) for r in got.collect())
    assert mine == vectors_by_hand(rows, 0.95)
    assert all(r.kept == (r.id is None or r.id == r.component_id) for r in got.collect())
    assert embedding_pairs.near_duplicates(df.limit(0)).count() == 0
    assert embedding_pairs.near_duplicates(df.where("vec_id = 2000")).collect()[0].n_links == 0


def test_vectors_of_several_lengths(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for size, n in ((16, 120), (8, 90), (1, 3), (3, 2)):
        base = rng.normal(size=(10, size))
        rows += [(len(rows) + i, (base[i % 10] + rng.normal(size=size) * 0.05 * (i % 4)).tolist()) for i in range(n)]
    rows += [(500, rows[130][1]), (501, rows[130][1]), (500, rows[0][1]), (502, [1.0, 2.0]), (503, [1.0, 2.0]), (504, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_pairs, "TILE", 50)
    links, roots = Counter(), Roots()
    for n, (i, v) in enumerate(rows):
        for m, (j, w) in enumerate(rows[:n]):
            if len(v) == len(w) and any(v) and any(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.95:
                links[n] += 1
                links[m] += 1
                roots.join(i, j)
    got = Counter((r.id, r.n_links, r.component_id) for r in embedding_pairs.near_duplicates(df).collect())
    assert got == Counter((i, links[n], roots.find(i)) for n, (i, _) in enumerate(rows))


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(3)
    x = embedding_pairs.unit(rng.normal(size=(200, 32)) + np.eye(32)[0] * 3)
    y = embedding_pairs.unit(np.concatenate([x[:50] + rng.normal(size=(50, 32)) * 0.04, rng.normal(size=(100, 32))]))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    for a, b in ((x, y), (x @ axes, y @ axes)):
        i, j, cosine = embedding_pairs.near_pairs(a, b, 0.9, [4, 8, 16])
        close = cosine >= 0.9
        assert set(zip(i[close], j[close])) == set(zip(*np.nonzero(x @ y.T >= 0.9)))


# --- shingles

def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components_by_hand(rows):
    roots, sets = Roots(), [(i, shingles(t)) for i, t in rows]
    for n, (i, s) in enumerate(sets):
        if i is None:
            continue
        roots.find(i)
        for j, t in sets[:n]:
            if j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                roots.join(i, j)
    return Counter((i, len(s), roots.find(i) if i is not None else None) for i, s in sets)


def near_copies(prose, families=12, members=14):
    """Texts with few to many words changed, cut or added, several of them again as they are; some share one passage."""
    rng = random.Random(11)
    rows, number, passage = [], 0, prose(77, 25)
    for f in range(families):
        origin = prose(1000 + f, rng.choice([6, 20, 80, 300])).split()
        for m in range(members):
            words = list(origin)
            for _ in range(int(len(words) * rng.choice([0, 0, 0.01, 0.02, 0.03, 0.05]) + rng.random())):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words = words[rng.randrange(1 + len(words) // 8) :]
            if rng.random() < 0.2:
                words += passage.split()
            rows.append((number, (" " if m % 2 else "\n ").join(words)))
            number += 3 if m % 5 else 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_similar_texts(block, spark, prose, odd, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "TASK_ROWS", 100)
    rows = odd + [(i + 50, t) for i, t in near_copies(prose)] + [(9000, "ONE two Three four"), (9001, "A b c d e f"), (9002, "a B c d e f")]
    rows += [(9001, rows[30][1]), (9003, "g h i j k l"), (9001, "g h i j k l"), (9001, "m n o p q r"), (9004, "m n o p q r")]
    rows += [(rows[40][0], ""), (rows[41][0], None), (rows[42][0], " ")]  # a second, empty text
    got = jaccard_join.jaccard_components(make_docs(spark, rows, extra=True).repartition(5))
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got.collect()) == components_by_hand(rows)


def test_exact_threshold():
    """Sets at, just above and just below the threshold, and prefixes that never miss a similar pair."""
    left = [np.arange(100, dtype=np.uint64)]
    at = [np.arange(80, dtype=np.uint64), np.arange(79, dtype=np.uint64), np.arange(125, dtype=np.uint64), np.arange(126, dtype=np.uint64)]
    for side in (left, left * 6):
        assert set(jaccard_join.similar_pairs(side, at, 80)[1]) == {0, 2}
    rng = np.random.default_rng(0)
    for _ in range(500):
        s = np.sort(rng.choice(60, rng.integers(1, 40), replace=False))
        t = np.sort(np.union1d(rng.permutation(s)[: max(1, len(s) - rng.integers(0, 4))], rng.choice(60, rng.integers(0, 3))))
        if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t)):
            matches = []
            for one in (s, t):
                need = int(jaccard_join.least_common(len(one), 80))
                m = jaccard_join.choose_matches(rng.integers(0, 3, len(one)).astype(np.uint8), len(one) - need + 1, need)
                matches.append((m, one[: len(one) - need + m]))
            assert len(np.intersect1d(matches[0][1], matches[1][1])) >= min(matches[0][0], matches[1][0])


def test_one_of_each_stays(spark, prose, odd):
    rows = odd + [(i + 50, t) for i, t in near_copies(prose, 4, 6)]
    docs = make_docs(spark, rows)
    kept = jaccard_join.keep_one_of_each(docs)
    want = Counter(i for i, _, c in components_by_hand(rows) if i == c)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter(set(want) - {None})
    assert kept.where("doc_id IS NULL").count() == 2
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


# --- repeated passages

def removed_by_hand(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1) if i is not None else []:
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1) if i is not None else []:
            if first[b[k : k + length]] < i:
                covered[k : k + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(bool(covered[k]) and (k == 0 or not covered[k - 1]) for k in range(len(b)))
        out[(i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length,block,batch,segment", [(50, 8 << 20, 1 << 16, 1 << 21), (50, 2000, 40, 300), (32, 700, 7, 64)])
def test_repeated_passages(length, block, batch, segment, spark, prose, odd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "BATCH_WINDOWS", batch)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rng = random.Random(6)
    passages = [prose(500 + k, n) for k, n in enumerate([5, 9, 12, 40])] + ["ab" * 60, "\0" * 70, "z" * 49]
    rows = [(rng.randrange(200), " ".join(rng.choice([prose(rng.random(), 5), rng.choice(passages)]) for _ in range(rng.randint(1, 6)))) for _ in range(120)]
    rows += [r for r in odd if r[0] != 6] + [(300, rows[0][1]), (301, rows[0][1]), (302, "\0" * 69 + "x")]
    docs = make_docs(spark, rows, extra=True).repartition(4)
    got = suffix_dedup.remove_repeats(docs, length=length)
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == removed_by_hand(rows, length)


def test_levels_stay_few():
    index = suffix_dedup.SuffixArrays(4)
    for k in range(64):
        windows = np.array([f"{k:04d}".encode(), b"same"], "S4")
        assert index.first_ids(windows, np.array([k, k])).tolist() == [k, 0]
    assert len(index.levels) <= 7 and sum(len(w) for w, _ in index.levels) == 65
    assert all((w[1:] > w[:-1]).all() for w, _ in index.levels)


def test_texts_are_cut(spark, prose):
    p = prose(1, 30)
    rows = [(1, p), (2, f"before é{p}ñ after"), (3, None), (4, p), (None, p)]
    docs = make_docs(spark, rows)
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[1].text == p and got[2].text == "before éñ after" and got[2].n_chars == 15 and got[3].text is None
    assert got[4].text == "" and got[4].n_chars == 0 and got[None].text == p
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_columns_with_clashing_names_stay(spark, prose, odd):
    """Stages that hand rows on keep columns that are named as their own."""
    passage = prose(3, 40)
    rows = [r for r in odd if r[0] not in (7,)] + [(20, passage + " " + prose(4, 30)), (21, prose(5, 30) + " " + passage), (22, prose(5, 30) + " " + passage)]
    docs = make_docs(spark, rows, extra=True).withColumn("_id", F.lit("mine")).withColumn("first_id", F.lit(0))
    plain = {r.doc_id: r.text for r in suffix_dedup.without_repeats(make_docs(spark, rows)).collect()}
    for stage in (suffix_dedup.without_repeats, jaccard_join.keep_one_of_each):
        got = stage(docs)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        kept = got.collect()
        assert {r["kept"] for r in kept} == {"x"} and {r["_id"] for r in kept} == {"mine"}
        assert stage(docs.limit(0)).count() == 0
        if stage is suffix_dedup.without_repeats:
            assert {r.doc_id: r.text for r in kept} == plain and passage not in plain[21]
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)


def test_rows_are_cut_where_they_lie(spark, prose, monkeypatch):
    """Blocks hold whole rows: no text is shuffled to be joined by an id, so rows with equal ids stay rows of their own."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 600)
    p, q = prose(61, 30), prose(62, 30)
    rows = [(1, p), (5, q + p), (5, p + q), (7, None), (7, "\0" + q), (8, "short"), (None, p), (9, p)]
    docs = make_docs(spark, rows).withColumn("when", F.lit("2020-02-02 02:02:02").cast("timestamp")).withColumn("more", F.array(F.struct("doc_id", F.lit(1.5).cast("decimal(9,2)").alias("x"))))
    docs = docs.repartition(3).withColumnRenamed("n_chars", "c0")
    got = suffix_dedup.without_repeats(docs, length_col="c0")
    assert got.dtypes == docs.dtypes
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert Counter((r.doc_id, r.text, r.c0) for r in got.collect()) == Counter(
        [(1, p, len(p)), (5, q, len(q)), (5, q, len(q)), (7, None, None), (7, "\0", 1), (8, "short", 5), (None, p, len(p)), (9, "", 0)]
    )
    kept = lambda df: Counter((r.doc_id, r.when, str(r.more)) for r in df.collect())
    assert kept(got) == kept(docs)


def test_cold_rows_keep_a_token_of_every_similar_pair(spark):
    """Random groups and prefix tokens: of the tokens two groups must share, at least one is left, and more if they need more."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        size = int(rng.integers(20, 600))
        matches = int(jaccard_join.least_matches(size)) + int(rng.integers(0, 4))
        tokens = rng.choice(60 if g % 2 else 300, size=min(50, matches * 2), replace=False)
        rows += [(int(t), g, size, size, matches) for t in tokens]
    frame = spark.createDataFrame(rows, "token long, group long, low long, high long, matches long")
    length = frame.groupBy("token").agg(F.count("*").alias("length"))
    cold = jaccard_join.cold_rows(frame.join(length, "token"), 80).collect()
    left, spare = {}, {}
    for r in cold:
        left.setdefault(r["group"], set()).add(r.token)
        spare[r["group"]] = r.spare
    whole, need, sizes = {}, {}, {}
    for t, g, size, _, m in rows:
        whole.setdefault(g, set()).add(t)
        need[g], sizes[g] = m, size
    tried = 0
    for a in whole:
        for b in whole:
            common = len(whole[a] & whole[b])
            if a < b and 80 * max(sizes[a], sizes[b]) <= 100 * min(sizes[a], sizes[b]) and common >= min(need[a], need[b]):
                tried += 1
                assert len(left[a] & left[b]) >= min(need[a], need[b]) - max(spare[a], spare[b]) >= 1
    assert tried > 10 and len(cold) < len(rows)


@pytest.mark.parametrize("name,table,key", [("op3_embedding_pairs", "embeddings", "vec_id"), ("op5_jaccard_join", "documents", "doc_id"), ("op10_suffix_dedup", "documents", "doc_id")])
def test_whole_tables(name, table, key, spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()
    got = queries.QUERIES[name](spark, sf_dir).collect()
    if table == "embeddings":
        want = vectors_by_hand([(r.vec_id, r.embedding) for r in rows], 0.95)
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    elif name.startswith("op5"):
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_hand([(r.doc_id, r.text) for r in rows])
    else:
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed_by_hand([(r.doc_id, r.text) for r in rows], 50)
