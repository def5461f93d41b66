import numpy as np
import pytest

from quire.llm import components, minhash, superminhash

from .common import frame, messy, words


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("percent", "bands"), [(85, 16), (80, 20)])
def test_components_equal_brute_force(spark, percent, bands):
    rows = messy(1, 60)
    want = brute(rows, percent)
    got = minhash.near_duplicates(frame(spark, rows), percent=percent, components=4 * bands, bands=bands).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [(1, "x")]).where("false")).count() == 0


def test_signatures_are_superminhash():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 5, 64, 500)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    m = 16
    got = superminhash.signatures(np.concatenate(sets), starts, m)
    for row, elements in zip(got, sets):
        want = [float("inf")] * m
        for e in elements:  # the plain algorithm, one element at a time
            p = list(range(m))
            for j in range(m):
                x = int(superminhash.mix64(np.array([(int(e) + j * superminhash._STEP) % 2**64], dtype=np.uint64))[0])
                k = j + ((x >> 32) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j * 2**32 + (x & 0xFFFFFFFF))
        assert [int(v) for v in row] == [2**64 - 1 if w == float("inf") else w for w in want]


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    s = superminhash.signatures(np.concatenate([a, b]), np.array([0, 400, 800]), 1024)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.05


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 301), (302, 301)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 300, 301: 300, 302: 300}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def by_id(rows, percent):
    """Components when the rows of one doc_id are one document."""
    keyed = [(k, t) for k, (i, t) in enumerate(rows) if i is not None]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, root) in brute(keyed, percent).items():
        x, y = sorted((find(rows[k][0]), find(rows[root][0])))
        parent[y] = x
    return {i: find(i) for i in parent}


def test_texts_that_share_a_doc_id(spark):
    def say(mark, n=80):
        return " ".join(f"{mark}{k}" for k in range(n))

    w, v = say("w"), say("v")
    rows = [(5, w), (5, v), (6, w + " tail"), (7, v + " tail"), (8, say("x")), (8, ""), (9, None), (9, say("x")), (2, "lone text"), (2, "other text here"), (None, w), (None, v)]
    rows += messy(4, 30) + [(i, t) for i, t in messy(5, 30) if i is not None]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    want = by_id(rows, 85)
    assert want[6] == want[7] == 5 or want[5] < 5
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted((i, len(shingles(t)), want[i]) for i, t in rows if i is not None)
    assert sum(r.doc_id is None for r in got) == sum(i is None for i, _ in rows)


def test_one_row_of_each_group_stays(spark):
    rows = messy(6, 40) + [(3, "different words " * 9), (3, None), (3, None), (None, "a row without an id " * 6), (None, "z " * 30), (1, "z " * 30)]
    got = minhash.representatives(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    groups = {}
    for k, (_, root) in brute(list(enumerate(t for _, t in rows)), 80).items():
        if shingles(rows[k][1]):
            groups.setdefault(root, set()).add(k)
    stay = [(r.doc_id, r.text) for r in got.collect()]
    worded = [x for x in stay if shingles(x[1])]
    assert sorted(map(repr, (x for x in stay if not shingles(x[1])))) == sorted(repr((i, t)) for i, t in rows if not shingles(t))
    assert len(worded) == len(groups)
    for members in groups.values():  # exactly one of each group, the smallest doc_id, null ids last
        low = min((rows[k][0] is None, rows[k][0] or 0) for k in members)
        assert sum((i is None, i or 0) == low and (i, t) in {rows[k] for k in members} for i, t in worded) == 1
    assert minhash.representatives(frame(spark, rows).where("false")).count() == 0


def test_hot_keys_are_joined_whole(spark):
    from quire.llm import pair_join

    left = spark.createDataFrame([(0, i) for i in range(3000)] + [(k, k) for k in range(1, 2000)] + [(-1, 0), (None, 1)], "k long, v long")
    right = spark.createDataFrame([(0, "hot", 3000)] + [(k, f"x{k}", 1) for k in range(1, 2000)], "k long, w string, n long")
    plain = {how: sorted(map(repr, left.join(right.drop("n"), "k", how).collect())) for how in ("inner", "left")}
    for how, want in plain.items():
        assert sorted(map(repr, pair_join.hot_join(left, right, ["k"], "n", how).collect())) == want
