"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Equal
fingerprints collapse first (a map-side minimum), so a group of copies is one row however large.
Seven masks over the 64 bits then cover radius 2: each bit gets a nonzero vector of three bits, and
mask v keeps the bits whose vector is orthogonal to v over GF(2). Two differing bits span at most two
of three dimensions, so some v is orthogonal to both, and the pair agrees on all bits that mask v
keeps (about 27 are masked out, 37 kept). Every pair within the radius thus meets in a bucket.

Within a bucket, fingerprints at distance 2 or less share a word that is at distance 1 or less from
both. Writing each one under its own value and its one-bit changes among the masked-out bits, and
linking all that meet to the smallest, finds exactly those pairs in linear time: there is nothing to verify and no
list of all pairs. A bucket too large for a task goes the same way as a distributed grouping, where
no group can have more than 65 members.

Results for odd input: a null or wordless text has fingerprint zero and links like any other;
repeated rows each get a row; a null doc_id gets a row, and never names a component (a component
of only such rows has a null id); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import chunks, drop_folder, new_folder, short_batches, written

RADIUS = 2
#: Distinct fingerprints of a bucket that one task solves by itself; larger buckets are dealt out.
TASK_BUCKET = 1 << 17
#: Bytes of a text that are split into words at a time.
TEXT_PIECE = 1 << 22
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Masks (unsigned) such that any ``radius`` bits are all outside at least one of them."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + i % n for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end before white space."""
    at = 0
    while at < len(text):
        end = at + TEXT_PIECE
        m = SPACE.search(text, end) if end < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint (unsigned) of a text's UTF-8 bytes."""
    import xxhash

    digest = xxhash.xxh64_digest
    counts, n, tail = np.zeros(64, np.int64), 0, []

    def add(found: list[bytes]) -> None:
        nonlocal n, counts
        for at in range(0, len(found), 1 << 15):
            raw = np.frombuffer(b"".join([digest(s, seed) for s in found[at : at + (1 << 15)]]), np.uint8)
            counts += np.unpackbits(raw).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(found)

    for piece in _pieces(text.lower()):  # bytes.lower and bytes.split know ASCII only
        words = tail + piece.split()
        add(list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))))
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not n and tail:
        add([b" ".join(tail)])
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of ``docs``."""

    def run(batches):
        for b in chunks(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _local_links(fps: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) that join all of ``fps`` that differ in at most two of ``bits``."""
    fps = np.unique(fps)
    words = np.concatenate([fps] + [fps ^ np.int64(signed(1 << b)) for b in bits])
    who = np.tile(np.arange(len(fps)), len(bits) + 1)
    order = np.lexsort((who, words))
    words, who = words[order], who[order]
    first = np.concatenate([[True], words[1:] != words[:-1]])
    least = who[np.maximum.accumulate(np.where(first, np.arange(len(words)), 0))]
    root = _roots(len(fps), who, least)
    moved = root != np.arange(len(fps))
    return fps[moved], fps[root[moved]]


def links(classes: DataFrame) -> DataFrame:
    """u, v: links that connect the distinct fingerprints ``classes.fp`` within the radius (each
    component is connected by them; they are not all pairs)."""
    spark = classes.sparkSession
    masks = covering_masks()
    outside = [[b for b in range(64) if not m >> b & 1] for m in masks]
    dealt = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("word")) for i, m in enumerate(masks)])).alias("k")).select("k.*", "fp")
    task_bucket = TASK_BUCKET

    def solve(batches):
        held: list[tuple[int, np.ndarray]] = []  # whole buckets of two or more, by mask
        size, run, run_key, run_size, deferred = 0, [], None, 0, False

        def out(u, v, mask):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(mask, pa.int32())], ["u", "v", "mask"])

        def flush():
            nonlocal held, size
            got = [_local_links(np.concatenate([f for m, f in held if m == mask]), outside[mask]) for mask in {m for m, _ in held}]
            held, size = [], 0
            if got:
                u, v = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                yield out(u, v, np.full(len(u), -1))

        def end():
            nonlocal run, run_size, size, deferred
            if run_key is not None and not deferred and run_size > 1:
                held.append((run_key[0], np.concatenate(run)))
                size += run_size
            run, run_size, deferred = [], 0, False

        for b in batches:
            mask, word, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "word", "fp"))
            if not len(fp):
                continue
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (word[1:] != word[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            single = (ends - starts == 1) & (np.arange(len(starts)) > 0) & (np.arange(len(starts)) < len(starts) - 1)
            for s, e in zip(starts[~single], ends[~single], strict=True):
                key = (int(mask[s]), int(word[s]))
                if key != run_key:
                    end()
                    run_key = key
                run.append(fp[s:e])
                run_size += int(e - s)
                if run_size > task_bucket:  # its fingerprints go on to the distributed grouping
                    deferred = True
                    f = np.concatenate(run)
                    yield out(f, f, np.full(len(f), key[0]))
                    run = []
                if size > task_bucket:
                    yield from flush()
        end()
        yield from flush()

    path = new_folder(spark, "links")
    dealt.repartition("mask", "word").sortWithinPartitions("mask", "word").mapInArrow(solve, "u long, v long, mask int").write.parquet(path)
    found = spark.read.schema("u long, v long, mask int").parquet(path)
    near = found.where("mask < 0").select("u", "v")
    large = found.where("mask >= 0")
    if large.limit(1).count():
        flips = F.array(*[F.array(F.col("u"), *[F.col("u").bitwiseXOR(F.lit(signed(1 << b))) for b in bits]) for bits in outside])
        words = large.select("u", F.explode(F.element_at(flips, F.col("mask") + 1)).alias("w"))
        least = words.groupBy("w").agg(F.min("u").alias("v"))
        near = near.unionByName(words.join(least, "w").where("u > v").select("u", "v"))
    return near.distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component of the undirected ``edges`` (u, v).

    Alternating large-star and small-star steps (Kiveris et al. 2014) on written tables; a
    hub's edges are joined with one row, which adaptive execution splits.
    """
    spark = edges.sparkSession

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"))

    def step(e: DataFrame) -> DataFrame:
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        m = least(both).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(m, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v").select(F.col("u").alias("a"), F.col("v").alias("b"))
        m2 = least(down)
        return down.join(m2, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(m2.select(F.col("a").alias("u"), F.col("m").alias("v"))).distinct()

    def stars(e: DataFrame) -> bool:
        """Does every node point to one smaller node that points nowhere?"""
        n = e.agg(F.count("*"), F.countDistinct("u")).first()
        return n[0] == n[1] and not e.join(e.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()

    now, path = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), None
    while True:
        last, path = path, new_folder(spark, "star")
        (step(now) if last else now).write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        if last:
            drop_folder(spark, last)
        if stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id of each row of ``docs`` (doc_id, text)."""
    with short_batches(docs.sparkSession):
        fps = written(fingerprints(docs, shingle, seed), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected(links(classes.select("fp")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = rooted.join(least, "root").select("fp", "component_id", "root")
    return fps.join(of_class, "fp").select("doc_id", "fp", "component_id", "root")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Dropped ids that are broadcast at most (8 bytes each); beyond that the join shuffles.
BROADCAST_IDS = 1_000_000


def text_fingerprint(text: bytes) -> int:
    return signed(fingerprint(text))


def keep_one(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates, key: Callable[[bytes], int] = text_fingerprint) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the document with the smallest doc_id.

    ``find`` gives the components as ``near_duplicates`` does; ``key`` is its fp of a text.

    Repeated rows of that doc_id count as one. Where a component has no doc_id at all, one of its texts stays.
    """
    found = written(find(docs), "components")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    ids = written(ids.where("not stays or n > 1"), "ids")
    gone, many = ids.where("not stays").select("doc_id"), ids.where("stays").select("doc_id")
    small = F.broadcast if gone.count() <= BROADCAST_IDS else lambda x: x
    kept = docs.where("doc_id is not null").join(small(gone), "doc_id", "left_anti").select(docs.columns)
    if many.limit(1).count():
        small = F.broadcast if many.count() <= BROADCAST_IDS else lambda x: x
        again = kept.join(small(many), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
        kept = kept.join(small(many), "doc_id", "left_anti").select(docs.columns).unionByName(again)
    nameless = found.where("doc_id is null and component_id is null").select("fp", "root").distinct()
    if nameless.limit(1).count():
        own = fingerprints_of_rows(docs.where("doc_id is null"), key).join(nameless, "fp")
        kept = kept.unionByName(own.dropDuplicates(["root"]).select("row.*"))
    return kept


def fingerprints_of_rows(docs: DataFrame, key: Callable[[bytes], int] = text_fingerprint) -> DataFrame:
    """``row`` (the columns of ``docs``) and fp."""

    @F.pandas_udf("long")
    def fp(texts):
        return texts.map(lambda t: key((t or "").encode()))

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), fp(F.col("text").cast("string")).alias("fp"))
