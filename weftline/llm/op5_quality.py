"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are shares and ratios of a whole text (letters, case, digits, each kind of mark, repeated words
and lines, compressibility, lengths). Labels are learnt from a bounded sample: the ``SAMPLE`` labelled
documents that come first by hash. The fitted arrays go to the workers, which score every document.

Results for odd input: a null text counts as empty and gets a score like any other; a document with several labels has their
mean, rounded up from one half; null labels are ignored; without labels every score is 0.5; null
doc_ids and repeated rows get a row each; an empty table gives an empty result; labels, lang,
source and doc_id are never features, and other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import chunks, crc32_of, first_by_hash, give_back, short_batches, written
from .gbt import Trees, constant, fit

#: Labelled documents that the model is fitted on at most.
SAMPLE = 20_000
CUT = 0.3
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FEATURES = [
    *(f"share_{chr(m)}" for m in MARKS),
    *("upper", "lower", "digits", "space", "other_bytes", "control", "entropy", "log_words", "word_mean", "word_sd", "word_longest"),
    *("distinct_words", "top_word", "top_three", "once", "log_lines", "distinct_lines", "line_mean", "packed"),
]
_UPPER, _LOWER, _DIGITS = slice(65, 91), slice(97, 123), slice(48, 58)


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    raw = text.encode("utf-8", "replace")
    n = len(raw) or 1
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = hist[hist > 0] / n
    words = text.split()
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    nw = len(words) or 1
    lines = text.split("\n")
    return [
        *(hist[list(MARKS)] / n).tolist(),
        hist[_UPPER].sum() / n, hist[_LOWER].sum() / n, hist[_DIGITS].sum() / n, hist[32] / n, hist[128:].sum() / n, hist[:32].sum() / n,
        float(-(p * np.log2(p)).sum()), float(np.log1p(len(words))), float(lens.mean()), float(lens.std()), float(np.log1p(lens.max())),
        len(counts) / nw, (top[0] if top else 0) / nw, sum(top) / nw, sum(1 for c in counts.values() if c == 1) / nw,
        float(np.log1p(len(lines))), len(set(lines)) / len(lines), float(np.log1p(len(text) / len(lines))), len(zlib.compress(raw, 1)) / n,
    ]


def features(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], float).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5) -> Trees:
    """Fit on the labelled documents whose crc32(doc_id) mod ``folds`` is not 0, ``sample`` of them at most."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    known = known.where(crc32_of("doc_id") % folds != 0).select("doc_id", (F.col("q") >= 0.5).cast("int").alias("y"))
    known = first_by_hash(known, ["doc_id"], sample)

    def run(batches):
        for b in chunks(batches):
            x = features(b.column("text").to_pylist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), kind)], ["doc_id", "y", "x"])

    # At most `sample` rows: broadcast on one side, collected on the other.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    first = rows.mapInArrow(run, "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.x", "r.y")
    with short_batches(docs.sparkSession):
        got = first.orderBy("doc_id").toArrow()
    if not got.num_rows:
        return constant(0.5)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return fit(x, got.column("y").to_numpy())


def score_of(text: Column, model: Trees) -> Column:
    """The score of a text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 512):
            out[at : at + 512] = model.score(features(texts.slice(at, 512).to_pylist()))
        give_back()
        return pa.array(out)

    return score(text.cast("string"))


def score_documents(docs: DataFrame, model: Trees, ident: str = "doc_id") -> DataFrame:
    """``ident`` and score of every row of ``docs``."""
    return docs.select(F.col(ident).cast("long").alias(ident), score_of(F.col("text"), model).alias("score"))


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``."""
    return docs.where(score_of(F.col("text"), train(docs, labels)) >= cut)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    with short_batches(spark):
        scored = written(score_documents(docs, train(docs, labels)), "scores")
    return scored.select("doc_id", (crc32_of("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
