import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import prose, rows_of, write_tables
from test_filters import walk
from test_similar import brute
from test_tokens import check_packing

import corpus_pipeline
from weftline.llm import op5_quality, op6_language, op7_mixing, op8_simhash, registry

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for held in groups.values():
        least = min((rows[i][0] for i in held if rows[i][0] is not None), default=None)
        out += [(rows[i][0], f"{fps[i]:016x}", least) for i in held]
    return sorted(out, key=repr)


def test_masks_cover():
    masks = op8_simhash.covering_masks()
    assert len(masks) == 7
    for a, b in combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)
    assert all(34 <= m.bit_count() <= 40 for m in masks)


def test_simhash_odd(spark, tmp_path, odd_rows, clashing, none):
    got = op8_simhash.op8_simhash(spark, write_tables(tmp_path, documents=clashing))
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert rows_of(got.select("doc_id", "fingerprint", "component_id")) == brute_components(odd_rows)
    assert op8_simhash.op8_simhash(spark, write_tables(tmp_path / "e", documents=none)).count() == 0


def test_simhash_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(registry.QUERIES["op8_simhash"](spark, d).select("doc_id", "fingerprint", "component_id")) == brute_components(rows)


def planted(seed, n=1500):
    """Distinct fingerprints in chains and clusters of small distance."""
    r = random.Random(seed)
    fps = set()
    while len(fps) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 5, 60])):
            fps.add(x)
            for b in r.sample(range(64), r.choice([1, 2, 2, 3])):
                x ^= 1 << b
    return sorted(fps)


@pytest.mark.parametrize("task_bucket", [1, 8, 1 << 17])
def test_links_find_every_component(spark, monkeypatch, task_bucket):
    """However small the buckets that a task solves itself: the rest goes the distributed way."""
    monkeypatch.setattr(op8_simhash, "TASK_BUCKET", task_bucket)
    fps = planted(4)
    df = spark.createDataFrame([(op8_simhash.signed(x),) for x in fps], "fp long")
    links = op8_simhash.links(df)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 200 for a, b in links.collect())
    got = {r.node: r.root for r in op8_simhash.connected(links).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(fps, np.uint64)
    for x in fps:
        for y in arr[np.bitwise_count(arr ^ np.uint64(x)) <= 2].tolist():
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    want = Counter(frozenset(v) for v in _groups({x: find(x) for x in fps}).values())
    have = Counter(frozenset(x & (2**64 - 1) for x in v) for v in _groups({op8_simhash.signed(x): got.get(op8_simhash.signed(x), op8_simhash.signed(x)) for x in fps}).values())
    assert want == have


def _groups(label):
    out = defaultdict(list)
    for x, r in label.items():
        out[r].append(x)
    return out


def test_connected_chain_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    got = {r.node: r.root for r in op8_simhash.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and all(got[i] == 1000 for i in range(1001, 1100))
    assert op8_simhash.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_text_in_pieces(monkeypatch):
    t = prose(5000, 1)
    want = brute_fingerprint(t)
    assert op8_simhash.fingerprint(t.encode()) == want
    monkeypatch.setattr(op8_simhash, "TEXT_PIECE", 11)
    assert op8_simhash.fingerprint(t.encode()) == want
    assert op8_simhash.fingerprint(b"a b") == brute_fingerprint("a b")


def test_one_of_each_group_stays(spark, odd_rows, clashing):
    kept = op8_simhash.keep_one(clashing)
    assert kept.columns == clashing.columns and {r.fp for r in kept.collect()} == {"extra"}
    comp = brute_components(odd_rows)
    named = {c for _, _, c in comp if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(named)
    only_null = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "x y z q"), (5, None), (6, "")], "doc_id long, text string")
    assert rows_of(op8_simhash.keep_one(only_null)) == sorted([(None, "a b c"), (None, "x y z q"), (5, None)], key=repr)


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas() if not isinstance(df, str) else duckdb.read_parquet(df))
    return sorted(con.execute(sql).fetchall(), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as from '/root/testdata/{sf}/documents.parquet'")
    want = con.execute(op7_mixing.SQL)
    names = [c[0] for c in want.description]
    got = registry.QUERIES["op7_mixing"](spark, f"/root/testdata/{sf}")
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.select(names)) == sorted(want.fetchall(), key=repr)


def skewed(spark, odd):
    r = random.Random(2)
    rows = [(i, prose(r.randint(1, 80), i), "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(900)]
    return spark.createDataFrame(rows, odd.schema)


def test_every_document_is_kept_and_repeats_are_limited(spark, odd):
    docs = skewed(spark, odd)
    got = op7_mixing.mix(docs).collect()
    times = Counter(r.doc_id for r in got)
    assert set(times) == set(range(900)) and max(times.values()) <= 2
    by = defaultdict(int)
    total = defaultdict(int)
    for r in got:
        by[r.source] += r.n_tokens
        if r.epoch == 0:
            total[r.source] += r.n_tokens
    share = {s: total[s] / sum(total.values()) for s in total}
    repeats = {r.source: r.repeats for r in got}
    assert max(repeats.values()) == pytest.approx(2, abs=1e-6) and min(repeats.values()) == 1
    weight = {r.source: r.weight for r in got}
    mixed = sum(by.values())
    for s in share:  # realised within a document or so of the weights
        assert by[s] / mixed == pytest.approx(weight[s], abs=80 / mixed + 0.002)
        assert by[s] <= repeats[s] * total[s] + 1
    a = np.log(weight["hot"] / weight["s0"]) / np.log(share["hot"] / share["s0"])
    for s in share:
        if s not in ("hot", "s0"):
            assert np.log(weight["hot"] / weight[s]) / np.log(share["hot"] / share[s]) == pytest.approx(a, abs=0.01)
    for s in share:  # a position is a place in one order of all sources
        assert all(0 <= r.position <= 1 for r in got if r.source == s)


def test_entropy_target_and_budget(spark, odd):
    docs = skewed(spark, odd)
    narrow = op7_mixing.written(op7_mixing.narrow_rows(docs), "t")
    sources, _ = op7_mixing.schedule(narrow, entropy=2.0)
    w = np.array([r.weight for r in sources.collect()])
    assert -(w * np.log2(w)).sum() == pytest.approx(2.0, abs=1e-4)
    budget = 9000
    got = op7_mixing.mix(docs, budget=budget, max_repeats=1.5).collect()
    assert budget * 0.95 < sum(r.n_tokens for r in got) <= budget + 10
    assert max(r.repeats for r in got) <= 1.5 + 1e-6


def test_mixing_odd(spark, odd_rows, clashing, none):
    got = op7_mixing.mix(clashing)
    assert Counter(r.doc_id for r in got.where("epoch = 0").collect()) == Counter(r[0] for r in odd_rows)
    assert op7_mixing.mix(none).count() == 0
    again = op7_mixing.mixed_documents(clashing)
    assert again.columns == clashing.columns and {r["_key"] for r in again.collect()} == {"extra"}
    assert Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in got.collect())
    assert op7_mixing.mixed_documents(none).count() == 0


def test_mixing_by_a_token_column(spark, odd):
    """Shares follow the counts that are given, not words."""
    docs = skewed(spark, odd)
    counted = docs.selectExpr("*", "case when source = 's0' then 1000 else length(text) end as `n.t`")
    rows = op7_mixing.mix(counted, tokens="n.t").collect()
    want = {r.doc_id: r["n.t"] for r in counted.collect()}
    assert all(r.n_tokens == want[r.doc_id] for r in rows)
    assert max((r for r in rows), key=lambda r: r.weight).source == max(((s, sum(r["n.t"] for r in counted.collect() if r.source == s)) for s in {r.source for r in rows}), key=lambda x: x[1])[0]
    assert op7_mixing.mixed_documents(counted, tokens="n.t").columns == counted.columns


def test_mixing_plan_has_no_python(spark, sf_dir):
    plan = registry.QUERIES["op7_mixing"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(name)
        if i < 4:
            assert docs.columns == columns and 0 < docs.count()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        was = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()} if i < 4 else {}
        if name == "language_id":
            assert set(was) - set(ids) == {d for d, t in was.items() if not any(c.isalpha() for c in t or "")} or len(ids) > 0.97 * len(was)
        if name == "quality":
            good = [d for d in was if labels.get(d) == 1]
            assert len(set(good) & set(ids)) >= 0.97 * len(good)
            assert not [d for d in ids if labels.get(d) == 0][3:]
        if name == "simhash_dedup":
            # The stage's definition: five-word shingles, similarity 0.8 or more, all pairs.
            assert sorted(ids) == sorted({c for _, c in brute([(d, t) for d, t in was.items()])})
        if name == "mixing":
            assert set(ids) == set(was) and max(Counter(ids).values()) <= 2
    assert seen == [n for n, _ in corpus_pipeline.STAGES]


def test_pipeline_brute_force(spark, sf_dir):
    """The whole pipeline's rows, from plain versions of its five stages: one document, tree, pair and source at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    langs, prototypes, limits = op6_language.learn(docs)
    seen = op6_language.Profiles()

    def known(text):
        low = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
        grams = Counter(zip(low, low[1:], low[2:], strict=False))
        if not low.strip():
            return False
        v = sum(n * np.roll(seen.letter(ord(a)), 2).astype(int) * np.roll(seen.letter(ord(b)), 1) * seen.letter(ord(c)) for (a, b, c), n in grams.items())
        best = max(float(v @ p) for p in prototypes) / np.linalg.norm(v)
        return best >= np.interp(np.log(len(grams)), np.log(limits[0]), limits[1])

    rows = [r for r in rows if known(r[1])]
    model = op5_quality.train(spark.createDataFrame(rows, docs.schema), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in rows if walk(model, op5_quality.statistics(r[1] or "")) >= 0.3]
    stay = {c for _, c in brute([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if r[0] in stay]
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(docs.columns, r, strict=True)) for r in rows]))
    times = Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({op7_mixing.SQL})").fetchall())
    text = {r[0]: r[1] for r in rows}
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    check_packing(got, [(d, text[d]) for d in times.elements()])


def test_pipeline_runs_whole(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    rows = got.collect()
    bins = defaultdict(int)
    for r in rows:
        bins[r.sequence_id] += r.length
    assert rows and max(bins.values()) <= 4096


def test_pipeline_of_nothing_and_odd(spark, tmp_path, odd, clashing, none):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    d = write_tables(tmp_path, documents=clashing, labels=labels)
    assert corpus_pipeline.run(spark, d).count() > 0
    d = write_tables(tmp_path / "e", documents=none, labels=labels)
    assert corpus_pipeline.run(spark, d).count() == 0
    assert op6_language.DIM and odd.count()
