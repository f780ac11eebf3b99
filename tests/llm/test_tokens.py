import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose, rows_of, write_tables
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import base, op2_token_files, op9_token_counts, op10_packing, registry, tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name):
    return Tokenizer.from_file(tokens.tokenizer_path(name))


@pytest.mark.parametrize("name", FILES)
def test_pieces_encode_like_whole_texts(name):
    r = random.Random(1)
    bits = [" ", "  ", "\n", "a", "B", "é", "́", "!", "1", "\xa0", "\t", "'s", "Σ", "ς", "İ", "中", "🙂", "word", " ", "ß", "\x1c", "<|endoftext|>", "　", "ﬁ", "\r", "ª", "don't", "Word.\nNext"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [prose(300, i) for i in range(20)] + [""]
    tok, plain, spans = library(name), tokens.PieceEncoder(tokens.tokenizer_path(name)), tokens.PieceEncoder(tokens.tokenizer_path(name), True)
    for t, ids, (ids2, where) in zip(texts, plain.encode(texts), spans.encode_spans(texts), strict=True):
        e = tok.encode(t, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids == ids2.tolist(), t
        assert [tuple(x) for x in where.tolist()] == e.offsets, t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    for name in FILES:
        assert np.frombuffer(tokens.encoder(tokens.tokenizer_path(name)).encode([text])[0], "<u4").tolist() == library_cache(name).encode(text, add_special_tokens=False).ids


_LIB = {}


def library_cache(name):
    return _LIB.setdefault(name, library(name))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    e, tok = tokens.PieceEncoder(tokens.tokenizer_path(FILES[0])), library(FILES[0])
    for i in range(10):
        t = prose(40, i % 3)
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def brute_files(rows, name=FILES[0], end=0):
    tok, start, out = library(name), 0, []
    for d, t, *_ in order(rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_pieces_are_given_up_where_they_differ():
    enc = tokens.PieceEncoder(tokens.tokenizer_path("byte_bpe_50k.json"), offsets=True)
    texts = ["one two three", "four five", "six"]
    want, spans = enc.encode(texts), enc.encode_spans(texts)
    for word in ("two", "five"):
        enc.cache[word] = enc.cache["three"]  # as a tokenizer would that joins words
    assert enc.encode(texts) == want and not enc.by_pieces
    assert all((a[1] == b[1]).all() for a, b in zip(enc.encode_spans(texts), spans, strict=True))


def test_one_doc_id_over_several_shards(spark, tmp_path):
    """A doc_id with a third of all rows, in several shards, and files that end early."""
    rows = [(7, f"{i % 50} a") for i in range(300)] + [(i, f"text {i}") for i in range(600)] + [(None, None)] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    listed = op2_token_files.write_token_files(docs, f"file://{tmp_path}/ids", tokens.tokenizer_path("byte_bpe_50k.json"), 0, 64, 50, 20)
    listed = base.written(listed, "shards")
    assert listed.select("shard").distinct().count() > 5 and listed.where("part > 0").count() > 3
    got = sorted(op2_token_files.read_token_files(listed).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


@pytest.mark.parametrize("shard_docs", [3, 1000])
def test_token_files(spark, tmp_path, odd_rows, clashing, shard_docs, monkeypatch):
    monkeypatch.setattr(op2_token_files, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(op2_token_files.write_token_files, "__defaults__", (0, 64, shard_docs, 1 << 26))
    d = write_tables(tmp_path, documents=clashing)
    got = op2_token_files.op2_token_files(spark, d)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert rows_of(got) == brute_files(odd_rows)


def test_token_files_of_nothing(spark, tmp_path, none):
    assert op2_token_files.op2_token_files(spark, write_tables(tmp_path, documents=none)).count() == 0


def test_random_access(tmp_path):
    w = op2_token_files.ShardWriter(f"file://{tmp_path}/s", 8, 50_257)
    r, flat = np.random.default_rng(0), []
    for i in range(3000):
        ids = r.integers(0, 50_000, r.integers(0, 40)).astype("<u4")
        flat.append(ids)
        w.add([i], [ids.tobytes()])
    w.close()
    flat = np.concatenate(flat)
    n = -(-len(flat) // 8)
    for i in [0, 1, 511, 512, 513, n - 2, n - 1]:
        ids, mask = op2_token_files.read_sequence(f"file://{tmp_path}/s.arrow", i)
        part = flat[8 * i : 8 * i + 8]
        assert ids.to_numpy(zero_copy_only=True)[: len(part)].tolist() == part.tolist()
        assert mask.to_pylist() == [True] * len(part) + [False] * (8 - len(part))
    schema = pa.ipc.open_file(f"{tmp_path}/s.arrow").schema
    assert schema.field("ids").type == pa.list_(pa.uint16(), 8)


def check_packing(got, rows, capacity=4096, end=1):
    tok, want = library(FILES[1]), []
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((d, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(spark, tmp_path, odd_rows, clashing, none):
    d = write_tables(tmp_path, documents=clashing)
    got = op10_packing.op10_packing(spark, d)
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packing([tuple(r) for r in got.collect()], odd_rows)
    assert op10_packing.op10_packing(spark, write_tables(tmp_path / "none", documents=none)).count() == 0


def test_packing_table_is_tight(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op10_packing.op10_packing(spark, "/root/testdata/sf0.01").collect()]
    n = check_packing(got, rows)
    assert n <= 1.01 * sum(r[3] for r in got) / 4096 + 1


def place(lengths, **how):
    """The bins of a plan: their pieces with offsets."""
    bins = {}
    for n, r0, r1, bin0, per, offset in zip(*op10_packing.plan(lengths, **how), strict=True):
        for rank in range(r0, r1):
            k = rank - r0
            bins.setdefault(bin0 + k // per, []).append((offset + k % per * n, n))
    return bins


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12), st.sampled_from(["dot", "norm"]), st.integers(1, 6), st.integers(2500, 5000))
def test_plan_keeps_every_capacity(lengths, measure, docs, attention):
    bins = place(lengths, capacity=50, max_docs=docs, max_attention=attention, measure=measure)
    counts = {}
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
            counts[n] = counts.get(n, 0) + 1
        assert at <= 50 and len(held) <= docs and sum(n * n for _, n in held) <= attention
    assert counts == lengths


def test_plan_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        op10_packing.plan({10: 1}, capacity=50, max_attention=99)


@pytest.mark.parametrize("rule", op9_token_counts.RULES)
def test_sections_match_brute_force(spark, odd_rows, clashing, rule):
    tok, want = library(FILES[0]), []
    for d, t, *_ in odd_rows:
        t = t or ""
        parts = t.splitlines(True) if "\r" not in t and not any(c in t for c in "\x0b\x0c\x1c\x1d\x1e\x85  ") else [p + "\n" for p in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else [])
        parts = parts or [""]
        bounds, at = [], 0
        for p in parts:
            bounds.append((at, at + len(p)))
            at += len(p)
        n, crossing = [0] * len(parts), [0] * len(parts)
        for a, b in tok.encode(t, add_special_tokens=False).offsets:
            over = [max(0, min(max(b, a + 1), e) - max(a, s)) for s, e in bounds]
            hit = [i for i, o in enumerate(over) if o] or [len(parts) - 1]
            i = {"first": hit[0], "last": hit[-1], "majority": max(hit, key=lambda i: (over[i], -i))}[rule]
            n[i] += 1
            crossing[i] += len(hit) > 1
        want += [(d, i, *bounds[i], n[i], crossing[i]) for i in range(len(parts))]
    got = op9_token_counts.section_counts(clashing, tokens.tokenizer_path(FILES[0]), rule)
    assert rows_of(got) == sorted(want, key=repr)


def test_boundary_crossing_rules():
    spans, starts = np.array([[0, 2], [2, 7], [7, 9]]), np.array([0, 3, 8])
    assert op9_token_counts.attribute(spans, starts, 9, "first")[0].tolist() == [2, 1, 0]
    assert op9_token_counts.attribute(spans, starts, 9, "last")[0].tolist() == [1, 1, 1]
    assert op9_token_counts.attribute(spans, starts, 9, "majority")[0].tolist() == [1, 2, 0]
    with pytest.raises(ValueError):
        op9_token_counts.attribute(spans, starts, 9, "none")


def test_fields_add_up(spark):
    rows = spark.createDataFrame([(1, "user", "Hello there.\nBye"), (2, None, "x"), (3, "a", None)], "id long, role string, text string")
    got = {r.id: (r.n_role, r.n_text) for r in op9_token_counts.field_counts(rows, ["id"], ["role", "text"], tokens.tokenizer_path(FILES[0])).collect()}
    tok = library(FILES[0])
    for i, role, text in [(1, "user", "Hello there.\nBye"), (2, "", "x"), (3, "a", "")]:
        assert sum(got[i]) == len(tok.encode(f"{role}\n{text}", add_special_tokens=False).ids)


def test_sections_of_nothing(spark, none):
    assert op9_token_counts.section_counts(none, tokens.tokenizer_path(FILES[0])).count() == 0


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = registry.QUERIES["op9_token_counts"](spark, d).groupBy("doc_id").sum("n_tokens").collect()
    tok = library(FILES[0])
    assert {r[0]: r[1] for r in got} == {k: len(tok.encode(t or "", add_special_tokens=False).ids) for k, t in docs.items()}
