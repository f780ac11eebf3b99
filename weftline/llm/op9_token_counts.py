"""Offset-mapped token counts: whole texts are encoded once, and tokens are attributed to sections or fields.

A document's tokens have character spans; so have its sections (its lines, each with its line break) or
its fields (the columns of a row, joined by a separator). Both are sorted, so the interval join is two binary searches
per token. A token that crosses a boundary goes to one section by an explicit rule:
"first" (where it begins), "last" (where it ends), or "majority" (the section that holds most of its
characters; the earlier one of equals). Every token counts exactly once, so sections add up to the document.

Results for odd input: a null or empty text is one empty section without tokens; empty lines are sections; a token of several byte-level parts
of one character counts where that character is; null doc_ids and repeated rows get rows of their own; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import chunks, short_batches, text_chunks, texts_of, written
from .tokens import MORE_PIECES, encoder, tokenizer_path

RULES = ("first", "last", "majority")
COLUMNS = "doc_id long, section int, char_start long, char_end long, n_tokens long, crossing long"


def attribute(spans: np.ndarray, starts: np.ndarray, end: int, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of them cross into or out of it.

    ``spans`` (n x 2) are the tokens' character spans, ``starts`` the ascending starts of the sections; the last one ends at ``end``.
    """
    n = len(starts)
    if not len(spans):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = np.maximum(np.searchsorted(starts, spans[:, 0], "right") - 1, 0)
    last = np.maximum(np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1, 0)
    to = first.copy()
    crosses = first != last
    if rule == "last":
        to = last.copy()
    elif rule == "majority":
        ends = np.append(starts[1:], end)
        for i in np.flatnonzero(crosses):
            a, b = spans[i]
            held = [min(b, ends[s]) - max(a, starts[s]) for s in range(first[i], last[i] + 1)]
            to[i] = first[i] + int(np.argmax(held))
    elif rule != "first":
        raise ValueError(f"the rule is one of {RULES}")
    return np.bincount(to, minlength=n), np.bincount(to[crosses], minlength=n)


def line_starts(text: str) -> np.ndarray:
    """Where the lines of a text begin; a line includes its line break."""
    lens = np.fromiter(map(len, text.split("\n")), np.int64) + 1
    starts = np.cumsum(lens) - lens
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(text) else starts


def section_counts(docs: DataFrame, tokenizer: str, rule: str = "majority") -> DataFrame:
    """Token counts of every line of every text of ``docs`` (doc_id, text): ``COLUMNS``."""
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")

    def run(batches):
        enc = encoder(tokenizer, offsets=True, pieces=MORE_PIECES)
        for b in text_chunks(batches, size=1 << 21):
            texts = texts_of(b.column("text"))
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            times = []
            for text, (_, spans) in zip(texts, enc.encode_spans(texts), strict=True):
                starts = line_starts(text)
                n, crossing = attribute(spans, starts, len(text), rule)
                for c, x in zip(cols, (np.arange(len(starts)), starts, np.append(starts[1:], len(text)), n, crossing), strict=True):
                    c.append(x)
                times.append(len(starts))
            ids = b.column("doc_id").take(pa.array(np.repeat(np.arange(len(texts)), times)))
            section, *rest = (np.concatenate(c).astype(np.int64) for c in cols)
            yield pa.RecordBatch.from_arrays([ids, pa.array(section.astype(np.int32)), *map(pa.array, rest)], [x.split()[0] for x in COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)


def field_counts(rows: DataFrame, ident: list[str], fields: list[str], tokenizer: str, separator: str = "\n", rule: str = "majority") -> DataFrame:
    """``ident`` columns, and a column n_<field> of tokens for each of ``fields``, whose texts are encoded as one.

    A separator's characters belong to the field before it.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    names = [*ident, *(f"n_{f}" for f in fields)]

    def run(batches):
        enc = encoder(tokenizer, offsets=True, pieces=MORE_PIECES)
        for b in chunks(batches, 128):
            parts = list(zip(*[texts_of(b.column(f"_f{i}")) for i in range(len(fields))], strict=True))
            texts = [separator.join(p) for p in parts]
            counts = []
            for p, text, (_, spans) in zip(parts, texts, enc.encode_spans(texts), strict=True):
                lens = np.array([len(x) + len(separator) for x in p], np.int64)
                counts.append(attribute(spans, np.cumsum(lens) - lens, len(text), rule)[0])
            columns = np.array(counts, np.int64).reshape(len(parts), len(fields)).T
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ident), *map(pa.array, columns)], names)

    chosen = rows.select(*ident, *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)])
    schema = ", ".join([*(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in ident), *(f"`n_{f}` long" for f in fields)])
    return chosen.mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = section_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
    with short_batches(spark):
        return written(counts, "token-counts")
