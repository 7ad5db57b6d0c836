"""Manifest, vector links and whitening against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from obscast.llm import langid, merkle, vector_links, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos long"
VECTORS = "vec_id long, embedding array<double>, label int, n_links long, node long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def path_of(levels, place):
    """(sibling or None, it lies to the left) by level."""
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append((level[other] if other < len(level) else None, place % 2 == 1))
        place //= 2
    return out


def fold(node, path):
    for other, left in path:
        node = sha(node if other is None else other + node if left else node + other)
    return node


def brute_manifest(rows):
    """Sorted rows of the contract, the plain way."""
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        mine = lambda n: sha("".join(map(field, (doc_id, source, lang, n, text))))  # noqa: E731, B023
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        changed = mine(n_chars + 1) if hit and n_chars is not None else mine(n_chars)
        groups.setdefault(lang, []).append((doc_id, mine(n_chars), changed))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = levels_of([r[1] for r in groups[g]])
    over = levels_of([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for place, (doc_id, leaf, changed) in enumerate(groups[g]):
            path = path_of(trees[g], place) + path_of(over, k)
            root, folded = over[-1][0], fold(changed, path)
            out.append((doc_id, leaf, trees[g][-1][0], root, sha("".join(o for o, _ in path if o)), folded, folded == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    rows = [(k, f"text {k} é\n", ["en", "de", None, ""][rng.randrange(4)], rng.choice(["web", None]), rng.choice([None, k])) for k in range(150)]
    rows += [(5, "again", "en", None, 3), (5, "again", "en", None, 3), (None, "x" * 300_000, "en", "s", (1 << 63) - 1), (None, None, "zz", "s", None)]
    rows += [(500 + k, "", "en" if k % 3 else "de", "s", 0) for k in range(100)]
    return [(*r, "own", 9) for r in rows]


def tampered_rows(frame, levels):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(frame, tampered, {"n_chars": (F.col("n_chars").cast("decimal(20, 0)") + 1).cast("string")}, levels)


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_is_that_of_the_plain_trees(spark, docs, levels):
    got = tampered_rows(spark.createDataFrame(docs, DOCS).repartition(5), levels)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute_manifest(docs)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want
    assert {r[-1] for r in want} == {True, False}


def test_a_version_shares_all_nodes_but_the_copied_ones(spark, docs):
    rows = [d for d in docs if d[2] == "en"]
    got = tampered_rows(spark.createDataFrame(docs, DOCS), 3).cache()
    leaves = [r.leaf for r in got.where("lang = 'en'").orderBy("pos").collect()]
    assert len(leaves) == len(rows)
    old, made = levels_of(leaves), {}
    for r in merkle.version_nodes(got).where("lang = 'en'").collect():
        made.setdefault(r.pos, {})[r.level, r["at"]] = r.node
    assert made
    for pos, nodes in made.items():
        new = levels_of([nodes.get((0, k), leaf) for k, leaf in enumerate(leaves)])
        for level, (a, b) in enumerate(zip(old, new, strict=True)):
            for at, (x, y) in enumerate(zip(a, b, strict=True)):
                assert y == (nodes[level, at] if at == pos >> level else x)
    assert got.where("verified and copied is not null and leaf <> copied[0]").isEmpty()


def test_manifest_of_few_rows(spark, docs):
    assert tampered_rows(spark.createDataFrame([], DOCS), 10).collect() == []
    one = spark.createDataFrame(docs[:1], DOCS)
    r = merkle.manifest(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified and r.copied is None


def near(vector, rng, size):
    return [v + rng.gauss(0, size) for v in vector]


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(40)]
    rows = [near(b, rng, s) for b in base for s in (0, 0.05, 0.2, 0.4, 0.5)]
    rows += [base[0]] * 30 + [[10 * v for v in base[1]], [-v for v in base[2]], [1e300 * v for v in base[3]], [1e-300 * v for v in base[3]]]
    rows += [near(base[5], rng, 0.02) for _ in range(120)]
    rows += [None, [], [0.0] * 12, [-0.0] * 12, [1.0, None] + [0.0] * 10, [math.nan] * 12, [math.inf] * 12, base[0][:5], base[0][:5], [0.0, -0.0, 1.0], [-0.0, 0.0, 1.0]]
    out = [(3 * k + 1, v, k % 4, 7, 8) for k, v in enumerate(rows)]
    out += [(1, base[20], 0, 7, 8), (None, base[20], 0, 7, 8), (None, [float(k == 11) for k in range(12)], 0, 7, 8)]
    rng.shuffle(out)
    return out


def brute_links(rows, threshold=0.9):
    good = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def unit(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    kept = [unit(v) if good(v) else None for _, v, *_ in rows]
    linked = [[j for j in range(len(rows)) if j != i and kept[i] is not None and kept[j] is not None and len(kept[i]) == len(kept[j]) and kept[i] @ kept[j] >= threshold] for i in range(len(rows))]
    low = list(range(len(rows)))
    rank = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    changed = True
    while changed:
        changed = False
        for i, j in ((i, j) for i in range(len(rows)) for j in linked[i]):
            if rank(low[j]) < rank(low[i]):
                low[i], changed = low[j], True
    return sorted(((r[0], len(linked[k]), rows[low[k]][0], r[0] == rows[low[k]][0]) for k, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("least", [4096, 40])
def test_links_are_all_pairs_above_the_threshold(spark, vectors, monkeypatch, least):
    monkeypatch.setattr(vector_links, "LEAST_ROWS", least)
    frame = spark.createDataFrame(vectors, VECTORS).repartition(3)
    got = vector_links.link_components(frame)
    want = brute_links(vectors)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert max(r[1] for r in want) > 100
    single = frame.withColumn("embedding", F.col("embedding").cast("array<float>")).where("abs(get(embedding, 0)) < 1e30 and abs(get(embedding, 0)) > 1e-30")
    rows = [tuple(r) for r in single.collect()]
    assert sorted((tuple(r) for r in vector_links.link_components(single).collect()), key=repr) == brute_links(rows)


def test_tile_bounds_hold_and_lose_nothing():
    rng = np.random.default_rng(3)
    monster = rng.normal(size=(300, 2100))
    for raw in (rng.normal(size=(300, 64)), rng.normal(size=(300, 3)), monster, np.eye(64) + 1e-9, rng.normal(size=(200, 64)) ** 9):
        unit = vector_links.units(raw)
        whole, scale, rest = vector_links.quantised(unit)
        cosine = unit @ unit.T
        product = vector_links.tile_products(whole, whole)
        assert np.array_equal(product, whole.astype(np.int64) @ whole.astype(np.int64).T)
        bound = rest[:, None] + (1 + rest[:, None]) * rest[None, :]
        assert (np.abs(cosine - product * scale[:, None] * scale[None, :]) <= bound + 1e-12).all()
        for threshold in (0.2, 0.9, 0.999):
            side = (whole, scale, rest)
            i, j = vector_links.candidates(side, side, threshold)
            found = set(zip(*(a.tolist() for a in vector_links.exact(i, j, unit, unit, threshold)), strict=True))
            assert found == set(zip(*(a.tolist() for a in np.nonzero(cosine >= threshold)), strict=True))


def test_forest_is_the_components():
    rng = random.Random(8)
    for n in (1, 5, 60):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        forest, plain = vector_links.Forest(n), list(range(n))
        for k in range(0, n, 7):
            forest.add(*(np.array(c) for c in zip(*pairs[k : k + 7], strict=True)))
        for _, (a, b) in itertools.product(range(n), pairs):
            plain[a] = plain[b] = min(plain[a], plain[b])
        assert forest.root.tolist() == plain


def test_links_of_few_vectors(spark):
    assert vector_links.link_components(spark.createDataFrame([], VECTORS)).collect() == []
    none = spark.createDataFrame([(2, None, 0, 0, 0), (None, [0.0], 0, 0, 0)], VECTORS)
    assert {tuple(r) for r in vector_links.link_components(none).collect()} == {(2, 0, 2, True), (None, 0, None, True)}


KINDS = {
    "plain": lambda r: r.normal(size=(90, 9)),
    "flat": lambda r: np.hstack([r.normal(size=(80, 3)), np.zeros((80, 9))]),
    "copies": lambda r: np.repeat(r.normal(size=(7, 8)), 12, axis=0),
    "unlike": lambda r: r.normal(size=(60, 8)) * np.logspace(-5, 5, 8),
    "equal": lambda r: np.vstack([np.eye(10), -np.eye(10)]) * 3.0,
    "one": lambda r: r.normal(size=(1, 4)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_spectra_are_those_of_the_scatter_matrix(kind):
    x = KINDS[kind](np.random.default_rng(7))
    parts = [whitening.Spectrum(x.shape[1]) for _ in range(3)]
    for k, v in enumerate(x):
        parts[min(2, 4 * k // len(x))].add(v)
    for p in parts[1:]:
        parts[0].merge(p)
    got, centred = parts[0], x - x.mean(axis=0)
    want = centred.T @ centred
    scale = max(1e-300, np.abs(want).max())
    assert np.allclose(got.mean, x.mean(axis=0)) and got.n == len(x)
    assert np.abs(got.vectors * got.values @ got.vectors.T - want).max() <= 1e-12 * scale
    assert np.abs(got.vectors.T @ got.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs(got.values - np.linalg.eigvalsh(want)).max() <= 1e-12 * scale


def test_whitening_is_that_of_the_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 9)  # many spectra, several rounds
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(240, 20)) * np.linspace(1, 4, 20) + 5
    raw[100:150] = raw[3]
    rows = [(k if k % 50 else None, v.tolist(), 0, 7, 8) for k, v in enumerate(raw)]
    odd = [None, [], [None] * 20, [math.nan] * 20, [math.inf] * 20, [1e300] * 20, [1.0] * 3]
    frame = spark.createDataFrame(rows + [(900 + k, v, 0, 7, 8) for k, v in enumerate(odd)], VECTORS)
    got = whitening.whiten(frame).collect()
    x = np.floor(64 * raw).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov((fit - 1_000_000).T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    white = ((x - 1_000_000) - (total - n * 1_000_000) / n) @ vectors[:, :16] / np.sqrt(values[:16])
    assert len(got) == 240 * 16 and {r.n for r in got} == {n}
    at = {}
    for r in got:
        at.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    sign = None
    for k, v in enumerate(x):
        own = at[k if k % 50 else None, int(((n * v - total) ** 2).sum())]
        mine = np.array([own[c].whitened for c in range(1, 17)])
        sign = np.sign(mine * white[k]) if sign is None else sign
        assert np.allclose(mine, sign * white[k], atol=1e-9)
        assert np.allclose([own[c].explained for c in range(1, 17)], values[:16] / values.sum(), rtol=1e-10)
    assert {r.identity_error for r in got if r.identity_error > 1e-9} == set()


def test_whitening_without_variance_and_of_very_wide_entries(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(4, [1.0, 2.0], 0, 0, 0)] * 3, VECTORS)).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained) for r in got] == [(4, 1, 0, None, 0.0)] * 6
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 7.0], 0, 0, 0) for k in range(5)], VECTORS)).collect()
    assert {r.component for r in line if r.whitened is None} == {2} and all(r.identity_error < 1e-12 for r in line)
    wide = whitening.whiten(spark.createDataFrame([(0, [0.0], 0, 0, 0), (1, [1e12], 0, 0, 0)], VECTORS)).collect()
    assert {r.deviation for r in wide} == {None} and sorted(round(r.whitened, 9) for r in wide) == [-1.0, 1.0]


def test_most_frequent_languages_are_learned_of_very_many(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(k, f"le chat noir dort sur la table numero {k}", "fr") for k in range(40)] + [(100 + k, f"the black cat sleeps on the table number {k}", "en") for k in range(40)]
    rows += [(1000 + k, "qqq www zzz", f"dirty{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.where("doc_id < 200"), model).collect()}
    assert all(got[k] == "fr" and got[100 + k] == "en" for k in range(40))
