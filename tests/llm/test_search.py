import math

import numpy as np
import pytest
from conftest import rows_of, write_tables

from weftline.llm import op1_voronoi, op3_anisotropic, registry

EMB = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 0) for i, v in rows], EMB)


def usable(v, zero=True):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def brute_products(rows, k=5, every=50):
    cands = sorted({(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and usable(v)})
    out = []
    for q in sorted({i for i, _ in cands if i % every == 0}):
        qv = min(v for i, v in cands if i == q)
        s = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in cands if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def odd_vectors():
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(40)] + [(50, rows[50][1])] * 9  # ties, repeated rows
    rows += [(400, None), (401, []), (402, [1.0, None, 0, 0, 0, 0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (450, [0.0] * 6), (None, [1.0] * 6), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (550, [1.0, 2.0, 3.0])]
    return rows


def test_products_match_brute_force(spark, odd_vectors):
    got = rows_of(op1_voronoi.top_products(vectors(spark, odd_vectors)).drop("scored"))
    assert got == brute_products(odd_vectors)


@pytest.mark.parametrize("how", [{}, {"data_block": 8, "query_block": 2}, {"pivots": 1}, {"pivots": 40, "data_block": 30}])
def test_products_beyond_doubles(spark, how):
    """Scores between 2**53 and 2**63, in clusters and spread out, in one block and in many."""
    r = np.random.default_rng(4)
    spread = [(i, [float(2**40 + i * 2**20), float(3 * i)]) for i in range(60)]
    centres = r.integers(-(2**29), 2**29, (8, 4))
    clusters = [(i, [float(x) for x in centres[i % 8] + r.integers(-9, 9, 4)]) for i in range(400)]
    for rows, scale in ((spread, 2**20), (clusters, 256)):
        rows = [(i, [x / scale for x in v]) for i, v in rows]
        schema = "vec_id long, embedding array<double>"
        got = rows_of(op1_voronoi.top_products(spark.createDataFrame(rows, schema), every=10, **how).drop("scored"))
        cands = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
        want = []
        for q, qv in cands[::10]:
            s = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in cands if i != q)
            want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:5])]
        assert got == sorted(want, key=repr)


def test_products_beyond_longs_are_an_error(spark):
    for v in ([1e30, 1.0], [2.0**36, 0.0]):
        with pytest.raises(op1_voronoi.ScoreOverflow):
            op1_voronoi.top_products(spark.createDataFrame([(50, v), (51, v)], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("how", [{}, {"data_block": 64, "query_block": 4}])
def test_clusters_prune_and_stay_exact(spark, how):
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 6)) * 20
    rows = [(i, (centres[i % 8] + r.normal(size=6) * 0.01).tolist()) for i in range(800)]
    found = op1_voronoi.top_products(vectors(spark, rows), **how).collect()
    assert sorted(((x.query_id, x.rank, x.vec_id, x.score) for x in found), key=repr) == brute_products(rows)
    scored = {x.query_id: x.scored for x in found}
    assert sum(scored.values()) < 0.5 * len(scored) * len(rows), sum(scored.values()) / len(scored) / len(rows)


def test_columns_with_names_of_our_own(spark, odd_vectors):
    """Columns called as the operators call theirs change nothing."""
    from pyspark.sql import functions as F

    plain = vectors(spark, odd_vectors)
    names = ["v", "cell", "dist", "code", "copy", "group", "b_q", "b_d", "salt", "bound", "n", "query_id", "rank", "score", "scored", "dim", "est", "err"]
    more = plain.select("*", *[F.lit("extra").alias(n) for n in names])
    assert rows_of(op1_voronoi.top_products(more).drop("scored")) == brute_products(odd_vectors)
    assert rows_of(op3_anisotropic.nearest(more)) == rows_of(op3_anisotropic.nearest(plain))


def test_many_lengths(spark):
    """Lengths beyond those that get an index are scanned whole."""
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=1 + i % 14).tolist()) for i in range(2800)]
    assert rows_of(op1_voronoi.top_products(vectors(spark, rows)).drop("scored")) == brute_products(rows)
    check_nearest(rows_of(op3_anisotropic.nearest(vectors(spark, rows))), brute_nearest(rows), 0.95)


def test_search_of_nothing(spark):
    empty = vectors(spark, [])
    assert op1_voronoi.top_products(empty).count() == 0
    assert op3_anisotropic.nearest(empty).count() == 0
    assert op1_voronoi.top_products(vectors(spark, [(50, [1.0])])).count() == 0


def brute_nearest(rows, k=10, every=100):
    cands = sorted({(i, tuple(np.float32(v).astype(float))) for i, v in rows if i is not None and usable(v, False)})
    out = {}
    for q in sorted({i for i, _ in cands if i % every == 0}):
        qv = np.array(min(v for i, v in cands if i == q))
        d = sorted((float(np.sqrt(((np.array(v) - qv) ** 2).sum())), i) for i, v in cands if i != q and len(v) == len(qv))
        out[q] = d[:k]
    return out


def check_nearest(got, want, least=0.9):
    by = {}
    for q, rank, i, s in sorted(got):
        by.setdefault(q, []).append((s, i))
        assert rank == len(by[q])
    assert set(by) == {q for q, d in want.items() if d}
    hits = total = 0
    for q, d in want.items():
        found = by.get(q, [])
        assert found == sorted(found) and len(found) == len(d)
        hits += len({i for _, i in found} & {i for _, i in d})
        total += len(d)
    assert hits / total >= least


def test_nearest_odd(spark, odd_vectors):
    got = rows_of(op3_anisotropic.nearest(vectors(spark, odd_vectors)))
    check_nearest(got, brute_nearest(odd_vectors))


def test_nearest_recall_on_table(spark, tmp_path):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = rows_of(op3_anisotropic.nearest(df))
    want = brute_nearest(rows)
    check_nearest(got, want, 0.95)
    exact = {(q, i): s for q, d in want.items() for s, i in d}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, _, i, s in got if (q, i) in exact)


@pytest.mark.parametrize("how", [{}, {"data_block": 3000, "query_block": 40}])
def test_nearest_recall_over_blocks(spark, how):
    """20 000 spread vectors and 10 000 in groups, in one block of codes and in ten; few are measured beyond the reranked."""
    r = np.random.default_rng(11)
    x = r.normal(size=(30_000, 32))
    x[::3] = x[r.integers(0, 60, 10_000) * 3] + r.normal(size=(10_000, 32)) * 0.05
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for q, _, i, _ in rows_of(op3_anisotropic.nearest(df, **how)):
        got.setdefault(q, set()).add(i)
    hits = []
    for q in ids[::100]:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.95 and np.mean(np.array(hits)[ids[::100] % 3 == 0]) >= 0.9


def test_no_vector_in_the_scan(spark):
    """The index holds codes and numbers, no vector."""
    assert "array" not in op3_anisotropic.INDEX


def test_nearest_of_huge_components(spark):
    rows = [(i, [1e200 * (i % 7 + 1), float(i)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(op3_anisotropic.nearest(df, k=3))
    want = sorted((math.hypot(v[0] - rows[100][1][0], v[1] - 100.0), i) for i, v in rows if i != 100)[:3]
    assert [(s, i) for q, _, i, s in got if q == 100] == [(pytest.approx(s), i) for s, i in want]


@pytest.mark.parametrize("noise", [0.001, 0.01, 0.03])
def test_nearest_in_a_dense_group(spark, noise):
    """A third of the rows are near-copies that share their codes."""
    r = np.random.default_rng(7)
    x = r.normal(size=(4500, 64)) / 8
    x[::3] = x[0] + r.normal(size=(1500, 64)) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = rows_of(op3_anisotropic.nearest(vectors(spark, rows)))
    want = brute_nearest(rows)
    dense = {q: d for q, d in want.items() if q % 3 == 0}
    check_nearest([g for g in got if g[0] in dense], dense, 0.95)
    check_nearest(got, want, 0.95)


def test_ties_of_copies_go_to_small_ids(spark):
    r = np.random.default_rng(5)
    same = r.normal(size=8).tolist()
    rows = [(i, same) for i in range(0, 900, 3)] + [(i, r.normal(size=8).tolist()) for i in range(1, 900, 3)]
    got = [x for x in rows_of(op3_anisotropic.nearest(vectors(spark, rows))) if x[0] == 300]
    assert [x[2] for x in sorted(got)] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]


def test_registered_queries(spark, tmp_path, odd_vectors):
    d = write_tables(tmp_path, embeddings=vectors(spark, odd_vectors))
    q = registry.QUERIES["op1_voronoi"](spark, d)
    assert q.dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    q = registry.QUERIES["op3_anisotropic"](spark, d)
    assert q.dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
