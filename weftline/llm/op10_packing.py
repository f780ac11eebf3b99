"""Vector best-fit packing of token pieces into sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared piece lengths).
Pieces go longest first; a piece goes to the open bin, among those with room under every capacity,
whose residual vector fits it best by a weighted measure: the largest dot product of the demand
with the bin's used shares, or the smallest norm of the residual that would be left.

A piece's demand follows from its length, and lengths are bounded by the capacity. So the choice
is made for counts, not rows: the histogram of lengths (at most one entry per length) goes to the
driver, equal bins are one entry with a count, and a whole class of equal pieces is placed in runs: "the pieces
of this length with ranks r0 to r1 fill these bins, q to a bin, from this offset". Rows then find
their run by (length, rank). The plan's size depends on the capacity and not on the corpus, and a
third of all rows having one length changes nothing. Ranks come from per-task counts, so no task
sees all pieces of a length.

Results for odd input: a null text is empty and holds just the end id; null doc_ids and repeated rows are packed as rows of their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import short_batches, text_chunks, written
from .tokens import encoder, tokenizer_path

CAPACITY = 4096
PIECES = "row long, task string, doc_id long, piece int, start long, length long, ids_crc32 long, rank long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids with the end id, cut where they exceed ``capacity``.

    ``task`` and ``rank`` number the pieces of a length within the task that made them.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc, task, seen, row = encoder(tokenizer), uuid.uuid4().hex, np.zeros(capacity + 1, np.int64), 0
        for b in text_chunks(batches):
            out = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text")), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    n = len(part) // 4
                    out.append((row, doc_id, k, at, n, zlib.crc32(part), int(seen[n])))
                    seen[n] += 1
                row += 1
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            arrays.insert(1, pa.array([task] * len(out)))
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan(lengths: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_attention: int | None = None, weights=(1.0, 1.0, 1.0), measure: str = "dot"):
    """Runs that place ``lengths`` (length: count), as arrays length, r0, r1, bin0, per_bin, offset.

    A run places the pieces of its length with ranks r0 <= rank < r1: piece ``rank`` goes to bin
    ``bin0 + (rank - r0) // per_bin`` at ``offset + (rank - r0) % per_bin * length``.
    """
    top = np.array([capacity, max_docs or capacity, max_attention or capacity * capacity], float)
    w = np.array(weights, float)
    groups: list[list] = []  # [residual tokens, docs, attention], first bin, bins, offset
    runs, next_bin = [], 0
    res = np.zeros((0, 3))
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        need = np.array([length, 1, length * length], float)
        if (need > top).any():
            raise ValueError(f"a piece of {length} tokens exceeds a bin's capacities")
        fits = np.flatnonzero((res >= need).all(1)) if len(res) else np.zeros(0, int)
        if measure == "dot":
            fit = ((1 - res[fits] / top) * (need / top) * w).sum(1)
        else:
            fit = -(((res[fits] - need) / top) ** 2 * w).sum(1)
        order = fits[np.lexsort((fits, -fit))]
        changed = []
        for g in [*order.tolist(), -1]:
            if not left:
                break
            if g < 0:
                per = int((top // need).min())
                bins = -(-left // per)
                groups.append([top.copy(), next_bin, bins, 0])
                next_bin += bins
                g = len(groups) - 1
            residual, first, bins, offset = groups[g]
            per = int((residual // need).min())
            full, extra = min(bins, left // per), 0
            if full < bins and left > full * per:
                extra = left - full * per
            rest = []
            if full:
                runs.append((length, rank, rank + full * per, first, per, offset))
                rest.append([residual - need * per, first, full, offset + per * length])
                rank, left = rank + full * per, left - full * per
            if extra:
                runs.append((length, rank, rank + extra, first + full, extra, offset))
                rest.append([residual - need * extra, first + full, 1, offset + extra * length])
                rank, left = rank + extra, left - extra
            if (over := bins - full - bool(extra)) > 0:
                rest.append([residual, first + full + bool(extra), over, offset])
            groups[g] = rest[0]
            changed += rest[1:]
        groups += changed
        groups = [x for x in groups if x[0][0] >= 1 and x[0][1] >= 1 and x[0][2] >= 1]
        res = np.array([x[0] for x in groups]).reshape(-1, 3)
    return [np.array(c, np.int64) for c in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 6


def pack(pieces: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """``pieces`` (written, with task, length and rank) with sequence_id and offset."""
    counts = pieces.groupBy("length", "task").count()
    # At most one row per possible length reaches the driver.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    length, r0, r1, bin0, per, offset = plan(histogram, capacity, **how)
    if not len(length):
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    order = np.lexsort((r0, length))
    length, r0, bin0, per, offset = (x[order] for x in (length, r0, bin0, per, offset))
    # A task's first rank among all pieces of a length: the counts of the tasks before it.
    before = "sum(count) over (partition by length order by task rows between unbounded preceding and 1 preceding)"
    first = counts.select(F.col("length").alias("l"), F.col("task").alias("t"), F.coalesce(F.expr(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, (F.col("length") == F.col("l")) & (F.col("task") == F.col("t"))).withColumn("rank", F.col("rank") + F.col("first")).drop("l", "t", "first")
    names = ranked.columns
    starts = {int(n): int(i) for n, i in zip(*np.unique(length, return_index=True), strict=True)}
    lows = np.array([starts.get(n, 0) for n in range(capacity + 1)])
    highs = np.searchsorted(length, np.arange(capacity + 1), "right")

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = np.zeros(len(n), np.int64)
            for v in np.unique(n):
                at = n == v
                run[at] = lows[v] + np.searchsorted(r0[lows[v] : highs[v]], rank[at], "right") - 1
            k = rank - r0[run]
            seq = bin0[run] + k // per[run]
            where = offset[run] + k % per[run] * n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(where)], [*names, "sequence_id", "offset"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema), "sequence_id long", "offset long"])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    """One row per piece of ``docs``: where it comes from and where it lies."""
    with short_batches(docs.sparkSession):
        pieces = written(cut_pieces(docs, tokenizer_path("word_bpe_49k.json"), end_id=1), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
