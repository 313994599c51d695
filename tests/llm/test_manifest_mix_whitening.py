"""Manifests, mixing and whitening against plain loops, and their odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from posequery.llm import merkle, mixing, queries, whitening
from posequery.llm.numbering import numbered


def save(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


# Manifests


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    values = list(row)
    if lower and values[4] is not None:
        values[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values[4])
    texts = [None if v is None else str(v) for v in values]
    return digest(*("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def climb(nodes):
    """Root of ``nodes``, and for each the siblings of each level as left and right lists."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, at):
            first = k // 16 * 16
            path.append((nodes[first:k], nodes[k + 1 : first + 16]))
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def plain_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append(row)
    first_null = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    names, out, roots, inner = sorted(trees, key=first_null), [], [], []
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, paths = climb([leaf_of(r) for r in own])
        roots.append(root)
        inner.append((own, paths))
    root, upper = climb(roots)
    for subroot, above, (own, paths) in zip(roots, upper, inner):
        for row, path in zip(own, paths):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node, proof = leaf_of(row, tampered), []
            for left, right in path + above:
                node = digest(*left, node, *right)
                proof += left + right
            out.append((row[0], leaf_of(row), subroot, root, digest(*proof), node, node == root))
    return out


def documents(n, sources, seed=3):
    rng = random.Random(seed)
    texts = [None, "", "plain", "Capital É", "x" * 3000, "TAB\tAB"]
    pick = lambda: "hot" if rng.random() < 0.4 else rng.choice(sources)
    return [(i * 3 - 50, pick(), rng.choice(["en", None]), rng.choice([None, 7]), rng.choice(texts) or None) for i in range(n)]


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n, sources", [(700, [None, "a", "é", "zz", ""]), (130, [f"s{i}" for i in range(40)]), (1, ["only"]), (17, ["hot"])])
def test_manifest_equals_a_plain_one(spark, tmp_path, n, sources):
    rows = documents(n, sources)
    rng = random.Random(1)
    shuffled = rng.sample(rows, len(rows))
    folder = save(spark, tmp_path, shuffled, DOCS, "documents")
    got = sorted(map(tuple, queries.op11_merkle(spark, folder).collect()))
    assert got == sorted(plain_manifest(rows))
    assert n < 100 or 0 < sum(not r[-1] for r in got) < n


def test_manifest_of_blocks_beyond_one(spark, monkeypatch):
    rows = documents(700, ["a"], seed=5)
    monkeypatch.setattr(merkle, "LEVELS", 1)  # aligned blocks of 16 leaves, upper versions above them
    table = spark.createDataFrame(rows, DOCS)
    found = merkle.manifest(table, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    paths = merkle.LEVELS
    assert paths == 1 and sorted(map(tuple, found.collect())) == sorted(plain_manifest(rows))


def test_manifest_of_odd_rows(spark):
    rows = documents(60, ["a", None], seed=9)
    rows += rows[:20] + [(None, None, None, None, None)] * 18 + [(7, "a", None, None, "y" * (1 << 21))]
    rows = [r for r in rows if r[0] is None or r[0] > -10]
    clash = spark.createDataFrame(
        [(*r, "x", "y", 1, 2) for r in rows], DOCS + ", leaf string, root string, tree int, place int"
    )
    found = sorted(map(repr, map(tuple, merkle.manifest(clash, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect())))
    assert found == sorted(map(repr, plain_manifest(rows)))
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    renamed = spark.createDataFrame(rows[:5], DOCS).withColumnsRenamed({"doc_id": "key", "text": "body"})
    assert all(r.verified for r in merkle.manifest(renamed, columns={"doc_id": "key", "text": "body"}).collect())


def test_numbers_follow_the_order(spark):
    rows = [(k % 3 if k % 7 else None, (k * 37) % 101) for k in range(101)]
    found = numbered(spark.createDataFrame(rows, "g long, v long"), ["g", "v"], ["g"]).collect()
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    assert all(sorted(groups[r.g])[r.place] == r.v for r in found) and len(found) == 101


# Mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped, budget = set(), sum(sizes.values())
    while True:
        left = budget - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        above = {s for s in names if s not in capped and weight[s] * left > 3 * sizes[s] * open_weight}
        if not above:
            break
        capped |= above
    return {s: 3.0 * sizes[s] if s in capped else float(weight[s] * left) / open_weight if open_weight else 0.0 for s in names}


def plain_mix(rows):
    size = {i: len((t or "").split()) for i, _, t in rows}
    sizes = Counter()
    for i, s, _ in rows:
        sizes[s] += size[i]
    target, turns, served = plain_targets(sizes), [], Counter()
    for i, s, _ in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        served[s] += size[i]
        if size[i] and target[s]:
            turns += [((k * sizes[s] + served[s]) / target[s], i, k) for k in range(3)]
    taken, spent, budget = Counter(), 0, sum(sizes.values())
    for _, i, _ in sorted(turns):
        spent += size[i]
        if spent > budget:
            break
        taken[i] += size[i]
    return sorted((i, size[i], sizes[s], target[s], taken[i]) for i, s, _ in rows)


MIX = "doc_id long, source string, text string"


def mixed_rows(seed, n=400):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "é", "😀", None, "small"]
    out = []
    for i in range(n):
        source = "a" if rng.random() < 0.4 else rng.choice(sources[:-1])
        out.append((i, "small" if i < 4 else source, " ".join(["w"] * rng.choice([0, 1, 5, 40]))))
    return out + [(n, "none", None), (n + 1, "none", " \t\n")]


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_a_plain_one(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(mixing, "_CHUNK", 16)  # many chunks and ranges
    rows = mixed_rows(seed)
    folder = save(spark, tmp_path, random.Random(9).sample(rows, len(rows)), MIX, "documents")
    found = sorted(map(tuple, queries.op12_mixing(spark, folder).collect()))
    assert found == plain_mix(rows)
    taken, target, size = Counter(), {}, dict((i, s) for i, s, _ in rows)
    for i, n, _, t, got in found:
        taken[size[i]] += got
        target[size[i]] = t
        assert 0 <= got <= 3 * n and (n == 0 or got % n == 0)
    assert math.isclose(sum(target.values()), sum(r[1] for r in found))
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    assert taken["small"] == 3 * sum(r[1] for r in found if size[r[0]] == "small")


def test_mix_of_odd_rows(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, None, "z"), (2, None, None), (3, "b", "w " * 600_000)]
    clash = spark.createDataFrame([(*r, 5, 6) for r in rows], MIX + ", size int, queue int")
    found = mixing.mix(clash).collect()
    assert len(found) == 5 and {(r.doc_id, r.size) for r in found} == {(1, 2), (None, 1), (2, 0), (3, 600_000)}
    assert sum(r.taken for r in found) <= 600_005
    empty = spark.createDataFrame([], MIX)
    assert mixing.mix(empty).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "a", None)], MIX)).collect()] == [0]
    shares = {r.doc_id: r.target for r in mixing.mix(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], MIX), weights=(1, 3)).collect()}
    assert shares == {1: 0.5, 2: 1.5}


# Whitening


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ np.diag(np.linspace(0.05, 0.6, d)) @ rng.normal(size=(d, d))).astype(np.float32)


VEC = "vec_id long, embedding array<float>"


def test_whitening_equals_numpy(spark, tmp_path):
    data = vectors(500, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    bad = [(-1, None), (-2, [1.0] * 11 + [float("nan")]), (-3, [float("inf")] * 12), (-4, [None] + [0.0] * 11)]
    found = queries.op13_whitening(spark, save(spark, tmp_path, rows + bad, VEC, "embeddings")).collect()
    x = np.floor(1024 * data.astype(np.float64)) + 100_000
    n, total = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(found) == 500 * 8 and {r.vec_id for r in found} == set(range(500))
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x]
    want = (x - total / n) @ axes[:, :8] / np.sqrt(values[:8])
    got = np.zeros((500, 8))
    for r in found:
        assert r.n == 500 and r.deviation == exact[r.vec_id]
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-9
        got[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8
    assert all(min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-8 for k in range(8))


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (7, 7), (9, 4), (64, 64)])
def test_factor_and_rotations(d, rank):
    rng = np.random.default_rng(d)
    root = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank)
    matrix = root @ root.T
    factor = whitening.pivoted_cholesky(matrix)
    assert factor.shape[1] == rank and np.abs(factor @ factor.T - matrix).max() < 1e-12
    turned = whitening.one_sided_jacobi(factor)
    norms = np.linalg.norm(turned, axis=0)
    assert np.allclose(norms**2, np.linalg.eigvalsh(matrix)[::-1][:rank], rtol=1e-8)
    unit = turned / norms
    assert np.abs(unit.T @ unit - np.eye(rank)).max() < 1e-12
    assert np.abs(turned @ turned.T - matrix).max() < 1e-12


def test_whitening_of_odd_rows(spark):
    table = lambda rows: spark.createDataFrame(rows, VEC)
    assert whitening.whiten(table([])).count() == 0
    assert whitening.whiten(table([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table([(1, [1.0, 2.0])] * 5)).count() == 0
    assert whitening.whiten(table([(1, None), (2, [])])).count() == 0
    two = whitening.whiten(table([(1, [1.0, 2.0]), (None, [2.0, 2.0]), (1, [1.0, 2.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])])).collect()
    assert [(r.vec_id, r.component, r.n) for r in sorted(two, key=lambda r: r.vec_id or 0)] == [(None, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert abs(two[0].explained - 1) < 1e-12
    clash = table([(1, [1.0, 2.0]), (2, [0.0, 5.0])]).withColumns({"component": F.lit(1), "vector": F.lit("v"), "n": F.lit(0)})
    assert whitening.whiten(clash).count() == 2
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [2.0**50, 1.0]), (3, [-(2.0**50), 1.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(huge).collect()
    assert {r.vec_id for r in found} == {2, 3} and all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-12 for r in found)


def test_sums_stay_exact_far_from_zero(spark):
    rows = [(i, [1e9 + i % 5, -3e8 + i % 3]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitening.whiten(table).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x)]
    assert all(r.deviation == sum((60 * v - s) ** 2 for v, s in zip(x[r.vec_id], total)) for r in found)
    assert found[0].identity_error < 1e-9
