import hashlib
import math
import random

import numpy as np
import pytest

from ledgerlens.llm import annulus_kmeans, block_topk, fill_middle, vectors

CLASHING = "vec_id long, embedding array<float>, label int, v string, h string, n string, cluster string, block string, rank string, score string, ids string, qg string"


def table(spark, rows):
    """rows: vec_id, embedding. The other columns bear names that the operators use."""
    return spark.createDataFrame([(i, e, 1, *("x",) * 9) for i, e in rows], CLASHING).repartition(3)


def points(seed, n, dim):
    """Copies, ties, vectors that take no part, repeated rows."""
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(0, 0.3 if i % 3 else 1.2))) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(20)] + rows[:4] + [(n + 30, [0.0] * dim), (n + 31, [0.5] + [0.0] * (dim - 1)), (n + 32, [-0.5] + [0.0] * (dim - 1))]
    rows += [(n + 40, None), (n + 41, []), (n + 42, [1.0] * (dim - 1)), (n + 43, [None] + [1.0] * (dim - 1)), (n + 44, [math.nan] * dim), (n + 45, [math.inf] * dim), (n + 46, [1.0] * (dim + 1))]
    return rows


def whole(v, dim=None):
    return v is not None and (dim is None or len(v) == dim) and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, k, rounds, dim, scale, seed):
    kept = [(i, v) for i, v in rows if whole(v, dim)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    vec = [(i, [math.floor(scale * x) for x in v]) for i, v in kept]
    centres = [v for _, v in vec[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = {}
        for _, v in vec:
            own.setdefault(near(v)[1], []).append(v)
        for j, vs in own.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return sorted((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in vec), centres


@pytest.mark.parametrize("big", [1.0, 1e9, 1e36])
def test_clusters(spark, big):
    """Against plain Lloyd rounds; of large components too, which Python's integers hold."""
    rows = [(i, v and [x if x is None else x * big for x in v]) for i, v in points(3, 60, 4)] + [(None, [0.25 * big] * 4)]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = table(spark, rows)
    assigned, centres = annulus_kmeans.cluster(df, 7, 3, 4)
    want, want_centres = lloyd(rows, 7, 3, 4, 256, "2")
    assert centres == want_centres
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in assigned.collect()) == [(i, c, min(d, vectors.LONG)) for i, c, d in want]


def test_annulus_leaves_out_what_is_too_far():
    """Exact with ties on the annulus' edge, and far from comparing every pair where norms differ."""
    r = np.random.default_rng(4)
    centres = [[int(x) for x in c] for c in (r.normal(size=(200, 8)) * np.linspace(1, 400, 200)[:, None]).round()]
    centres += [centres[3], [5, 0, 0, 0, 0, 0, 0, 0], [0, 5, 0, 0, 0, 0, 0, 0], [-5, 0, 0, 0, 0, 0, 0, 0]]
    x = np.vstack([(r.normal(size=(300, 8)) * r.uniform(1, 400, 300)[:, None]).round(), np.array(centres[:9]), np.zeros((1, 8)), np.full((1, 8), 3.0)])
    near = annulus_kmeans.Annulus(centres)
    number, apart = near.nearest(x)
    all_pairs = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
    assert (number == all_pairs.argmin(axis=1)).all() and (apart == all_pairs.min(axis=1)).all()
    assert near.compared < 0.5 * all_pairs.size


def test_cluster_query(spark):
    rows = points(5, 150, 64)
    got = annulus_kmeans.op11(table(spark, rows)).collect()
    want, centres = lloyd(rows, 40, 5, 64, 256, "2")
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == want
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_few_vectors_and_none(spark):
    assert annulus_kmeans.op11(table(spark, points(5, 30, 64)[-7:])).count() == 0
    assert [(r.vec_id, r.cluster, r.distance) for r in annulus_kmeans.op11(table(spark, [(5, [1.0] * 64)])).collect()] == [(5, 0, 0)]
    assert block_topk.op13(table(spark, [])).count() == 0
    assert block_topk.op13(table(spark, [(100, [1.0])])).count() == 0


def topk(rows, every, k, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if whole(v)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        product = lambda y: max(-vectors.LONG + 1, min(vectors.LONG - 1, sum(s * t for s, t in zip(x, y, strict=False))))  # noqa: E731, B023
        found = sorted((-product(y), math.inf if i is None else i) for b, (i, y) in enumerate(kept) if b != a)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("big", [1.0, 1e12])
def test_topk(spark, big, monkeypatch):
    """Against all pairs: small blocks, several groups of both sides, repeated queries, other lengths, null ids."""
    monkeypatch.setattr(block_topk, "CELL_BLOCKS", 4)
    monkeypatch.setattr(block_topk, "QUERY_ROWS", 10)
    rows = [(i, v and [x if x is None else float(np.float32(x * big)) for x in v]) for i, v in points(6, 120, 5)] + [(None, [0.7 * big] * 5), (-10, [0.25 * big] * 5)]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    index = block_topk.index
    monkeypatch.setattr(block_topk, "index", lambda t, scale: index(t, scale, 16))
    got = block_topk.exact_topk(table(spark, rows), 5, 10).collect()
    assert sorted((r.query_id, r.rank, math.inf if r.vec_id is None else r.vec_id, r.score) for r in got) == topk(rows, 5, 10, 1024)


def test_topk_query(spark):
    rows = points(8, 400, 64)
    got = block_topk.op13(table(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == topk(rows, 100, 10, 1024)


def test_topk_leaves_blocks_out():
    """Blocks whose bound is below the k-th score are not scored."""
    r = np.random.default_rng(7)
    n, d = 64, 12
    x = np.floor(r.normal(size=(n * 32, d)) * 20 + np.repeat(r.normal(size=(n, d)) * 400, 32, axis=0))
    rows = [block_topk.Block({"block": b, "n": 32, "ids": [*range(b * 32, b * 32 + 32)], "narrow": False, "forward": x[b * 32 : b * 32 + 32].tobytes()}) for b in range(n)]
    per = x.reshape(n, 32, d)
    q = x[::100]
    own = [(int(i) // 32, int(i) % 32) for i in range(0, len(x), 100)]
    score, ids, met = block_topk.search(q, np.full(len(q), block_topk.NOTHING), own, rows, per.max(axis=1), per.min(axis=1), 10)
    s = q @ x.T
    s[np.arange(len(q)), np.arange(0, len(x), 100)] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s), axis=-1)[:, :10]
    assert (ids == want).all() and (score == np.take_along_axis(s, want, 1)).all()
    assert met < 0.3 * len(q) * n


def test_elias_fano():
    r = random.Random(9)
    for n, universe in ((1, 1), (1, 10**6), (700, 701), (5000, 20_000), (3000, 10**7), (257, 300)):
        values = sorted(r.sample(range(universe), n))
        ef = fill_middle.EliasFano(np.array(values), universe)
        assert len(ef) == n and [ef[i] for i in range(n)] == values
    dense = fill_middle.EliasFano(np.arange(100_000), 100_000)
    assert dense.nbytes < 100_000 * 0.3


def middle(doc_id, text):
    t = text or ""
    n, h = len(t), hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(t)


def test_fill_in_middle(spark, monkeypatch):
    """Against plain slices: copies dealt by a salt, texts of one to four bytes a character, marks and parts of them, a megabyte, nulls, repeated rows, clashing names."""
    monkeypatch.setattr(fill_middle, "IDS", 3)
    r = random.Random(11)
    alphabet = "ab <>PSM\n\té中😀\x00"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(200)] + ["a text that many share 中"] * 150 + [None, "", "", "x", "<P>", "a<S>b", "<<P", "😀" * 300_000, "<P", "M>", "\n"]
    rows = [(i * 3 - 50 if i % 50 else None, t) for i, t in enumerate(texts)]
    rows += rows[5:9] + [(1, "one"), (1, "another")]
    df = spark.createDataFrame([(i, t, *("x",) * 6) for i, t in rows], "doc_id long, text string, key string, salt string, ids string, n string, form string, output string").repartition(5)
    key = lambda x: tuple((v is None, v) for v in x[:3]) + (x[5],)
    assert sorted((tuple(g) for g in fill_middle.op12(df).collect()), key=key) == sorted((middle(*x) for x in rows), key=key)
    out = {(g.doc_id, g.output) for g in fill_middle.fill_middle(df).collect()}
    assert (1, "one") in out or any(i == 1 and "<M>" in o for i, o in out)
    assert fill_middle.op12(df.limit(0)).count() == 0


def test_hot_texts_are_dealt_out(spark):
    rows = [(i, "shared " * 50 if i % 3 == 0 else f"text {i} " * 50) for i in range(600)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS key", "text")
    hot = fill_middle.hot_texts(keyed, 8)
    assert len(hot) == 1 and 8 <= next(iter(hot.values())) <= 32
