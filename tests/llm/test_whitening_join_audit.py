"""Whitening, similarity join and filter audit against brute force and on edge cases."""

import re
import tracemalloc
from itertools import permutations

import numpy as np
import pytest

from retailcast.llm import filter_audit, prefix_join, whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int, deviation long, whitened double, key long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 0.5, 3) for i, v in rows], EMBEDDINGS)


@pytest.mark.parametrize(
    "values",
    [np.r_[np.full(20, 5.0), np.linspace(0, 1, 44)], np.arange(10.0), np.linspace(0, 1, 64) ** 4, np.r_[1e6, 1e3, 1, np.zeros(30)], np.array([2.0, 2, 1])],
)
def test_contour_finds_the_leading_eigenpairs(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values), len(values))))
    matrix = (q * values) @ q.T
    found, basis = whitening.leading(matrix, 8)
    want = np.sort(values)[::-1][: min(8, (values > 0).sum())]
    assert np.allclose(found, want, rtol=1e-9, atol=1e-12 * values.max())
    assert np.allclose(matrix @ basis, basis * found, atol=1e-13 * values.max() * len(values))
    assert np.allclose(basis.T @ basis, np.eye(len(found)), atol=1e-12)
    for shift in np.random.default_rng(4).random(20) * values.max():
        assert whitening.Inertia(matrix).above(shift) == (values > shift).sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    data = (rng.standard_normal((300, 12)) * np.linspace(0.3, 0.05, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(7, data[7].tolist()), (None, data[8].tolist())]
    rows += [(900, None), (901, [None] + data[0, 1:].tolist()), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [1.0]), (905, [])]
    out = whitening.whiten(vectors(spark, rows)).toPandas()
    x = np.floor(1024 * np.concatenate([data, data[[7, 8]]]).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    assert len(out) == 8 * n and set(out["n"]) == {n} and out["component"].dtype == np.int32
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    want = c @ basis / np.sqrt(values)
    for k in range(1, 9):
        part = out[out["component"] == k]
        got = part[part["vec_id"].isin(range(300))].drop_duplicates("vec_id").sort_values("vec_id")
        sign = np.sign(got["whitened"].to_numpy() @ want[:300, k - 1])
        assert np.allclose(got["whitened"], sign * want[:300, k - 1], atol=1e-9)
        assert np.allclose(part["explained"], values[k - 1] / np.trace(c.T @ c / n), rtol=1e-9)
        assert got["deviation"].tolist() == ((n * x - s) ** 2).sum(1)[:300].tolist()


def test_whitening_of_small_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 5)).count() == 0  # no spread, no component
    two = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.5])])).collect()
    assert len(two) == 2 and sorted(round(abs(r["whitened"]), 9) for r in two) == [1, 1]


def test_deviation_beyond_64_bits_is_null():
    big = np.array([[1 << 40, -(1 << 40)], [3, 4]], object)
    assert whitening.squares(big) == [None, 25]
    assert whitening.exact_centre(np.array([[1 << 52]]), 1 << 20, [5]).tolist() == [[(1 << 72) - 5]]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, comp long, token long, n long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, 3, 4) for i, t, s in rows], DOCS)


def shingles(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, percent=90):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def edited(rng, words, k):
    words = list(words)
    for at in rng.choice(len(words), k, replace=False):
        words[at] = f"n{rng.integers(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("piece", [1024, 3])
def test_prefix_join_against_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_join, "PIECE", piece)
    rng = np.random.default_rng(piece)
    rows = [(1, "Alpha beta", "s"), (2, "alpha\tBETA", "s"), (3, "", "s"), (4, None, "s"), (5, " \n ", "s"), (None, "alpha beta", "s"), (6, "ÄB c", "s"), (6, "ÄB c", "s"), (7, "äb c", "s"), (None, None, "s")]
    for g in range(6):  # near copies of a long shared passage, some similar to each other and some not
        base = [f"w{v}" for v in rng.integers(0, 40 + 400 * g, 100)]
        rows += [(len(rows) + 100, edited(rng, base, int(k)), "s") for k in rng.integers(0, 5, 14)]
    rows += [(900, "long text here " * 4000 + "tail one", "s"), (901, "long text here " * 4000 + "tail one", "s")]
    got = [tuple(r) for r in prefix_join.similar_groups(docs_of(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == brute_components(rows)
    assert len({r[2] for r in got}) < len(rows) - 10


def block_of(size, groups, comps, spread):
    rng = np.random.default_rng(size)
    bits = np.tile(rng.integers(0, 2**63, prefix_join.BITMAP // 64, np.uint64), (size, 1))
    bits[:, 0] ^= rng.integers(0, spread, size).astype(np.uint64)
    gid = rng.integers(0, groups, size)
    pos, n = rng.integers(0, 3, groups)[gid], rng.integers(90, 110, groups)[gid]
    node = rng.permutation(10 * size)[:size]
    comp = node if comps is None else rng.integers(0, comps, size)
    return node, gid, n, pos, comp, bits, rng.integers(0, 2, size).astype(bool)


@pytest.mark.parametrize(("nearest", "linked"), [(True, False), (True, True), (False, True)])
def test_pairs_of_a_block_against_all_pairs(monkeypatch, nearest, linked):
    monkeypatch.setattr(prefix_join, "ROWS", 7)
    monkeypatch.setattr(prefix_join, "SENT", 50)
    for size in (1, 2, 60, 150):
        node, gid, n, pos, comp, bits, mine = block = block_of(size, 20, 9, 1 << 12)
        if not linked:
            comp, block = node, (*block[:4], node, *block[5:])
        possible = {}
        for a in range(size):
            for b in range(size):
                sized = 100 * min(n[a], n[b]) >= 90 * max(n[a], n[b]) and 190 * (1 + min(n[a] - pos[a] - 1, n[b] - pos[b] - 1)) >= 90 * (n[a] + n[b])
                fits = pos[a] == 0 if gid[a] == gid[b] else sized
                apart = int(np.bitwise_count(bits[a] ^ bits[b]).sum())
                crossed = mine.any() and not mine.all()
                if comp[a] != comp[b] and fits and (not crossed or mine[a] != mine[b]) and 190 * apart <= 10 * (n[a] + n[b]):
                    possible.setdefault((a, comp[b] if nearest and linked else 0), []).append((apart, node[b]))
        want = {tuple(sorted((node[a], m))) for (a, _), found in possible.items() for _, m in ([min(found)] if nearest else found)}
        runs = list(prefix_join.pairs_in(*block, 90, nearest, linked))
        assert {tuple(p) for run in runs for p in run.tolist()} == want
        assert all(len(run) == len(np.unique(run, axis=0)) for run in runs)


@pytest.mark.parametrize("linked", [False, True])
def test_a_block_of_near_copies_needs_little_memory(linked):
    node, gid, n, pos, comp, bits, mine = block_of(2 * prefix_join.PIECE, 1, 3 if linked else None, 8)
    block = node, gid, n, pos * 0, comp, bits, mine
    tracemalloc.start()
    pairs = sum(len(run) for run in prefix_join.pairs_in(*block, 90, True, linked))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs and peak < 40 << 20


def test_prefix_join_of_no_rows(spark):
    assert prefix_join.similar_groups(docs_of(spark, [])).count() == 0
    assert prefix_join.similar_groups(docs_of(spark, [(1, None, "s")])).collect() == [(1, 0, 1)]


@pytest.mark.parametrize("size", [100, 20_000])
def test_set_sizes_are_exact(size):
    rng = np.random.default_rng(size)
    text = " ".join(f"w{v}" for v in rng.integers(0, size // 3, size))
    rows, _, hashes = prefix_join.shingle_set(text, 3)
    assert len(rows) == len(set(hashes.tolist())) == len(shingles(text))
    assert len(prefix_join.shingle_set(text, 7)[0]) == len(shingles(text, 7))  # keys are renumbered on the way


def brute_audit(rows, labels):
    first, out = {}, {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    docs = []
    for doc_id, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and doc_id > first[t],
        }
        docs.append((source or "", {f for f in fails if fails[f]}, labels.get(doc_id, (0, 0))))
    for part in {d[0] for d in docs}:
        own, shares = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [d for d in own if not d[1] & set(order[:k])]
                hit = [d for d in left if f in d[1]]
                shares[f] += len(hit)
                all_hit = [d for d in own if f in d[1]]
                out[part, "".join(order), k + 1] = [len(left) - len(hit), len(hit), len(all_hit) - len(hit), sum(d[1] == {f} for d in own), sum(d[2][0] for d in hit), sum(d[2][1] for d in hit)]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(shares[f])
    return out


def test_filter_audit_against_all_orders(spark):
    long = " ".join(f"word{i}" for i in range(250))
    rows = [(1, long, "a"), (2, long, "b"), (2, long, "b"), (3, "short TEXT #1", None), (4, "", "a"), (5, None, "a"), (None, long, "a"), (None, None, ""), (6, "x " * 500, "b"), (7, long + " & more", "b"), (8, "ABC", ""), (9, long, "a"), (9, long, "b"), (0, "x " * 500, "c")]
    marks = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (9, None, 1), (9, 1, 0), (None, 1, 1), (8, 7, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    counts = filter_audit.pattern_counts(docs_of(spark, rows), labels)
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(counts).collect()}
    assert got == brute_audit(rows, {1: (1, 0), 2: (1, 1), 3: (0, 1), 9: (1, 1)})
    assert filter_audit.audit(filter_audit.pattern_counts(docs_of(spark, []), labels)).count() == 0
