"""Language ID with hyperdimensional profiles.

Each letter has a random vector of signs, from a generator seeded by its code point. Three consecutive letters (runs of
other characters count as one blank) bind to the product of their vectors, rotated by two, one and
no places, so that order matters. A document bundles its n-gram vectors, by frequency; a language's
prototype bundles those of its documents, each of unit length. The prediction is the prototype with the largest cosine.

Learning uses a bounded sample: of each of the ``MOST_LANGS`` most frequent languages the ``SAMPLE`` documents that come first by hash of the doc_id, or of the
text where that is null. Whole texts are read; distinct n-grams are counted first, and their vectors are kept by the worker.

A pipeline drops documents that speak none of the languages. The cosine of a text with its own language grows with its length, so the sample also
tells what to expect: pieces of ``PIECES`` characters are cut from it, and the least cosine that passes, at each length, is the lower
of ``SHARE`` of the pieces' median and ``SPREAD`` of their deviations below it. A text's length counts in distinct n-grams, so that a few words
repeated weigh as little as they tell. Between the lengths the limit is interpolated; below the shortest any letter passes.

Results for odd input: a text that is null or has no letter is ``und`` with score 0; a null lang is
not learnt from; without anything to learn all are ``und``; ties go to the lang that sorts first; null doc_ids and
repeated rows get a row each; an empty table gives an empty result; lang, source and doc_id
never enter a prediction, and other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import PLACES, Scratch, chunks, crc32_of, give_back, place_of, short_batches, written

DIM = 512
#: Documents of a language that are learnt from at most.
SAMPLE = 1000
#: Languages that are learnt at most.
MOST_LANGS = 1000
#: Characters of the pieces that say which cosine a text of that length has in its own language.
PIECES = (20, 40, 80, 160, 320, 640, 1280, 2560)
SHARE, SPREAD = 0.45, 2.5
#: Steps of the cosine, from -1 to 1, in which pieces are counted.
STEPS = 400
#: N-grams whose vectors a worker keeps; beyond that it starts afresh.
KEPT_GRAMS = 100_000
#: Characters of a text whose n-grams are counted at a time.
TEXT_PIECE = 1 << 20
BLANK = 32


class Profiles:
    """N-gram vectors, made as they are met."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self._clear()
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x3000)])

    def _clear(self) -> None:
        self.codes = np.zeros(0, np.uint64)  # sorted
        self.rows = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.dim), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = (np.random.Generator(np.random.Philox(key=c)).integers(0, 2, self.dim) * 2 - 1).astype(np.int8)
        return self.letters[c]

    def _gram(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of a text and how often they occur; nothing if it has no letter."""
        found, counts, tail, some = [], [], np.array([BLANK], np.uint64), False
        low = text.lower()
        for at in range(0, len(low), TEXT_PIECE):
            cp = np.frombuffer(low[at : at + TEXT_PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
            near = cp < len(self.is_letter)
            is_letter = np.zeros(len(cp), bool)
            is_letter[near] = self.is_letter[cp[near]]
            if not near.all():
                far = np.flatnonzero(~near)
                kinds = {c: chr(c).isalpha() for c in set(cp[far].tolist())}
                is_letter[far] = [kinds[c] for c in cp[far].tolist()]
            some = some or bool(is_letter.any())
            x = np.where(is_letter, cp, BLANK).astype(np.uint64)
            x = np.concatenate([tail, x])
            if at + TEXT_PIECE >= len(low):
                x = np.append(x, np.uint64(BLANK))
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != BLANK) | (x[:-1] != BLANK)
            x = x[keep]
            tail = x[-2:]
            code, n = np.unique(x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:], return_counts=True)
            found.append(code)
            counts.append(n)
        if not some:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(found) == 1:
            return found[0], counts[0]
        code, where = np.unique(np.concatenate(found), return_inverse=True)
        return code, np.bincount(where, np.concatenate(counts)).astype(np.int64)

    def _rows(self, code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        if not known.all():
            if len(self.codes) > KEPT_GRAMS:
                self._clear()
                known[:] = False
            new = code[~known]
            vectors = np.stack([self._gram(int(c)) for c in new])
            rows = np.arange(len(self.vectors), len(self.vectors) + len(new))
            self.vectors = np.concatenate([self.vectors, vectors])
            codes = np.concatenate([self.codes, new])
            order = np.argsort(codes)
            self.codes, self.rows = codes[order], np.concatenate([self.rows, rows])[order]
            at = np.searchsorted(self.codes, code)
        return self.rows[at]

    def vectors_of(self, texts: list[str | None]) -> np.ndarray:
        """The unit vectors of texts; zero where there is no letter."""
        return self.vectors_and_sizes(texts)[0]

    def vectors_and_sizes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The unit vectors of texts, and how many distinct n-grams each bundles."""
        out, sizes = np.zeros((len(texts), self.dim), np.float32), np.zeros(len(texts), np.int64)
        parts = [self.grams(t) if t else (np.zeros(0, np.uint64), None) for t in texts]
        some = [c for c, _ in parts if len(c)]
        if not some:
            return out, sizes
        self._rows(np.unique(np.concatenate(some)))  # all that are new at once
        for i, (code, n) in enumerate(parts):
            if len(code):
                sizes[i] = len(code)
                v = n.astype(np.float32) @ self.vectors[self._rows(code)].astype(np.float32)
                out[i] = v / max(float(np.sqrt((v * v).sum())), 1e-9)
        return out, sizes


_PROFILES: dict[int, Profiles] = {}


def profiles(dim: int = DIM) -> Profiles:
    """The worker's own n-gram vectors."""
    return _PROFILES.setdefault(dim, Profiles(dim))


def _sample(docs: DataFrame, sample: int, folds: int, held_out: int) -> DataFrame:
    """lang and text of the rows that are learnt from."""
    known = docs.where("lang is not null and text is not null").where(crc32_of("doc_id") % folds != held_out)
    # Without a doc_id the text gives the place: all such rows would share one otherwise.
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("place", F.when(F.col("doc_id").isNull(), place_of("text")).otherwise(place_of("doc_id")))
    ids = known.select("doc_id", "lang", "place")
    # Only places that about twice the sample stays below are sorted, whatever a language's size; repeated rows count once.
    sizes = ids.groupBy("lang").agg(F.approx_count_distinct("place").alias("size")).orderBy(F.desc("size"), "lang").limit(MOST_LANGS)
    enough = 1.5 * sample + 8 * sample**0.5
    ids = ids.join(F.broadcast(sizes), "lang").where(F.col("place") <= F.lit(float(PLACES)) / F.col("size") * enough)
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = ids.select("doc_id", "lang", "place").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    # `sample` ids for each of MOST_LANGS languages at most: small enough to broadcast.
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), F.col("place").alias("at")))
    same = known.doc_id.eqNullSafe(chosen.id) & (known.lang == chosen.of) & (known.place == chosen["at"])
    return known.join(chosen, same, "left_semi").select("lang", "text")


def _prototypes(rows: DataFrame, dim: int) -> tuple[list[str], np.ndarray]:
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in chunks(batches):
            v = profiles(dim).vectors_of(b.column("text").to_pylist())
            for lang, row in zip(b.column("lang").to_pylist(), v, strict=True):
                sums[lang] = sums.get(lang, 0) + row.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "v"])

    total = [F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(dim)]
    got = rows.mapInArrow(run, "lang string, v array<double>").groupBy("lang").agg(*total).orderBy("lang").collect()  # MOST_LANGS rows at most
    if not got:
        return [], np.zeros((0, dim), np.float32)
    p = np.array([r[1:] for r in got], float)
    norm = np.sqrt((p * p).sum(1))
    fine = norm > 0
    return [r.lang for r, f in zip(got, fine, strict=True) if f], (p[fine] / norm[fine, None]).astype(np.float32)


def _piece(text: str, n: int) -> str | None:
    """``n`` characters from a place in the text that its length decides."""
    return text[(len(text) * 7919) % (len(text) - n + 1) :][:n] if len(text) >= n else None


def limits_of(rows: DataFrame, langs: list[str], prototypes: np.ndarray) -> np.ndarray:
    """The distinct n-grams of pieces of each of ``PIECES`` lengths, and the least cosine that passes there, from rows lang, text."""
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches):
        counts = np.zeros((len(PIECES), STEPS + 1), np.int64)  # the last place sums n-grams
        for b in chunks(batches):
            some = [(t, place[lang]) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if lang in place]
            for k, n in enumerate(PIECES):
                cut = [(p, i) for t, i in some if (p := _piece(t, n))]
                if cut:
                    v, size = profiles(prototypes.shape[1]).vectors_and_sizes([p for p, _ in cut])
                    cos = (v * prototypes[[i for _, i in cut]]).sum(1)[size > 0]
                    counts[k, :STEPS] += np.bincount(np.clip((cos + 1) / 2 * STEPS, 0, STEPS - 1).astype(int), minlength=STEPS)
                    counts[k, STEPS] += size.sum()
        k, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(step, pa.int32()), pa.array(counts[k, step])], ["k", "step", "n"])

    counts = np.zeros((len(PIECES), STEPS + 1))
    for r in rows.mapInArrow(run, "k int, step int, n long").groupBy("k", "step").agg(F.sum("n").alias("n")).collect():  # a row a length and step
        counts[r.k, r.step] = r.n
    return limits_from(counts)


def limits_from(counts: np.ndarray) -> np.ndarray:
    """Sizes and limits from counts of pieces by length and step; a length that few texts reach is left out."""
    sizes, out, last = [1.0], [0.0], 0.0
    for *row, total in counts:
        row = np.array(row)
        if row.sum() >= 30:
            middle = ((np.arange(STEPS) + 0.5) / STEPS * 2 - 1)[np.searchsorted(row.cumsum(), np.array([0.1, 0.5]) * row.sum())]
            deviation = (middle[1] - middle[0]) / 1.2816  # a normal tenth
            last = max(last, min(SHARE * middle[1], middle[1] - SPREAD * deviation), 0.0)
            if total / row.sum() > sizes[-1]:
                sizes.append(total / row.sum())
                out.append(last)
    return np.array([sizes, out])


def limit_at(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The least cosine that passes for texts with so many distinct n-grams."""
    return np.interp(np.log(np.maximum(sizes, 1)), np.log(limits[0]), limits[1])


def train(docs: DataFrame, sample: int = SAMPLE, folds: int = 4, held_out: int = 2, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """The languages, and their prototypes as rows of unit length."""
    with short_batches(docs.sparkSession):
        return _prototypes(_sample(docs, sample, folds, held_out), dim)


def learn(docs: DataFrame, sample: int = SAMPLE, folds: int = 4, held_out: int = 2, dim: int = DIM) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages, their prototypes and the least cosines that pass."""
    with Scratch(docs.sparkSession) as scratch, short_batches(docs.sparkSession):
        rows = scratch.written(_sample(docs, sample, folds, held_out), "language-sample")
        langs, prototypes = _prototypes(rows, dim)
        return langs, prototypes, limits_of(rows, langs, prototypes)


def predict(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language of each text, its cosine, from 0 to 1, and how many distinct n-grams it was judged by."""
    v, sizes = profiles(prototypes.shape[1]).vectors_and_sizes(texts)
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts)), sizes
    cos = v.astype(np.float64) @ prototypes.T.astype(np.float64)
    best = cos.argmax(1)
    some = (v != 0).any(1)
    score = np.where(some, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0)
    return [langs[b] if s else "und" for b, s in zip(best, some, strict=True)], score, sizes


def judged(text: Column, langs: list[str], prototypes: np.ndarray, limits: np.ndarray | None = None) -> Column:
    """A struct for a text: lang, score, and whether it is ``known``: in a learnt language, as far as its length can tell."""

    @F.arrow_udf("lang string, score double, known boolean")
    def judge(texts: pa.Array) -> pa.Array:
        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(texts), 512):
            said, score, size = predict(texts.slice(at, 512).to_pylist(), langs, prototypes)
            known = np.array([s != "und" for s in said], bool)
            if limits is not None:
                known &= score >= limit_at(size, limits)
            for x, y in zip(out, (said, score.tolist(), known.tolist()), strict=True):
                x += y
        give_back()
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["lang", "score", "known"])

    return judge(text.cast("string"))


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged(F.col("text"), langs, prototypes).alias("j"))
    return found.select("doc_id", F.col("j.lang").alias("lang_pred"), "j.score")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in one of the learnt languages."""
    return docs.where(judged(F.col("text"), *learn(docs))["known"])


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with short_batches(spark):
        found = written(identify(docs, *train(docs)), "languages")
    return found.select("doc_id", (crc32_of("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")
