"""Approximate nearest neighbours: anisotropic product quantisation, four-bit scans, exact reranking.

A vector is its coarse centre plus a scaled direction, x = c + s u, and u is cut into subspaces of two components with 16 centres each. So a dense
group is resolved by the codes as well as the whole space is. Centres and codes of the directions minimise the
score-aware loss of Guo et al. (2020), h_par |r_par|^2 + h_perp |r_perp|^2, where r_par is the part
of the residual along x: it harms the products that matter, those of queries close to x, and weighs
(d - 1) T^2 / (1 - T^2) times as much. Coarse centres and codebook are trained on a bounded sample (``SAMPLE`` vectors, dealt
by hash); every vector is encoded. Two four-bit codes make a byte, so a scan adds one table entry per four components.

With r the residual of x and y its code's vector, |q - x|^2 = |q|^2 + |x|^2 - 2 <x, r> - 2 <q, y> - 2 <q - x, r>; all but the last term is known
to the scan, and that is taken as ``ERRORS`` standard errors, |q - x| |r| / sqrt(d) each, and never as more than |q - x| |r|.

1. Scan: blocks of codes (no vectors) and of queries. A block gives each query its share of the ``RERANK`` nearest by estimate, and
   says how near any other of the block could be.
2. The ``RERANK`` nearest of all blocks are joined with the original vectors and measured exactly, which gives the k-th distance found.
3. Blocks that could still hold something nearer, by the errors, are scanned again for it, and what they find is measured exactly too. So groups
   that share their codes are measured whole.

Blocks have fixed sizes and are dealt by hash; equal vectors keep only the k + 1 smallest ids, which loses nothing.

Results for odd input: vectors null, zero, or holding null or non-finite components take no part; vectors of different
lengths are never compared (lengths beyond the most frequent are scanned exactly); components beyond 1e150, whose squares overflow, are compared after scaling all
by the largest; a repeated row counts once; a query without candidates gives no rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import Scratch, chunks, first_by_hash, written
from .op1_voronoi import _matrix, _to_pivots, blocked, by_length, distinct_vectors, each, usable

SAMPLE = 8192
#: Coarse centres at most.
MOST_COARSE = 256
THRESHOLD = 0.2
RERANK = 320
ERRORS = 2.0
SUB, CENTRES = 2, 16
#: Codes of a block, and queries.
DATA_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 12
#: Largest component that is squared as it is.
LARGE = 1e150


class Quantiser:
    """Anisotropic product quantiser of scaled directions from coarse centres, for vectors of one length."""

    def __init__(self, dim: int, threshold: float = THRESHOLD):
        self.dim = dim
        self.m = -(-dim // (2 * SUB)) * 2  # an even number of subspaces: two codes to a byte
        # h_par / h_perp - 1; one component has no perpendicular part
        self.eta = max(0.0, (dim - 1) * threshold**2 / (1 - threshold**2) - 1)
        self.books = np.zeros((self.m, CENTRES, SUB))
        self.coarse = np.zeros((1, dim))

    def _cut(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, self.m * SUB - self.dim)))
        return x.reshape(len(x), self.m, SUB)

    def _centres(self, x: np.ndarray, rng) -> None:
        n = min(MOST_COARSE, max(1, int(np.sqrt(len(x)))))
        c = x[rng.choice(len(x), n, replace=False)]
        for _ in range(6):
            near = _to_pivots(x, c).argmin(1)
            count = np.bincount(near, minlength=n)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        self.coarse = c

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Coarse centre, scale, scaled direction cut into subspaces, and the part of each along x."""
        cell = _to_pivots(x, self.coarse).argmin(1)
        rest = x - self.coarse[cell]
        scale = np.maximum(np.sqrt((rest * rest).mean(1)), 1e-300)
        unit = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
        return cell, scale, self._cut(rest / scale[:, None]), self._cut(unit)

    def fit(self, x: np.ndarray, rounds: int = 4, seed: int = 1) -> Quantiser:
        rng = np.random.default_rng(seed)
        self._centres(x, rng)
        _, _, cut, unit = self._parts(x)
        for j in range(self.m):  # plain k-means to begin with
            c = cut[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), j]
            for _ in range(6):
                near = ((cut[:, j, None] - c) ** 2).sum(-1).argmin(1)
                n = np.bincount(near, minlength=CENTRES)
                total = np.stack([np.bincount(near, cut[:, j, s], CENTRES) for s in range(SUB)], 1)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            self.books[j] = c
        size = self.m * CENTRES * SUB
        whole = (cut * unit).sum((1, 2))
        for _ in range(rounds):
            codes = self._codes(cut, unit)
            # Normal equations of the loss in all centres at once.
            slot = (np.arange(self.m) * CENTRES + codes)[:, :, None] * SUB + np.arange(SUB)
            along = np.zeros((len(x), size))
            np.put_along_axis(along, slot.reshape(len(x), -1), unit.reshape(len(x), -1), 1)
            a = self.eta * along.T @ along
            a[np.diag_indices(size)] += np.bincount(slot.ravel(), minlength=size) + 1e-9
            b = np.bincount(slot.ravel(), cut.ravel(), size) + self.eta * along.T @ whole
            self.books = np.linalg.solve(a, b).reshape(self.m, CENTRES, SUB)
        return self

    def _codes(self, cut: np.ndarray, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n x m) by coordinate descent on the anisotropic loss."""
        plain = np.empty((len(cut), self.m, CENTRES))
        along = np.empty((len(cut), self.m, CENTRES))
        for j in range(self.m):
            r = cut[:, j, None] - self.books[j]
            plain[:, j] = (r * r).sum(-1)
            along[:, j] = (r * unit[:, j, None]).sum(-1)
        codes = plain.argmin(2)
        rows = np.arange(len(cut))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for j in range(self.m):
                rest = total - along[rows, j, codes[:, j]]
                codes[:, j] = (plain[:, j] + self.eta * (rest[:, None] + along[:, j]) ** 2).argmin(1)
                total = rest + along[rows, j, codes[:, j]]
        return codes

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes (n x m / 2: two to a byte), coarse centres, scales, |x|^2 - 2 <x, r> and |r| of each row's residual r."""
        cell, scale, cut, unit = self._parts(x)
        codes = self._codes(cut, unit)
        direction = self.books[np.arange(self.m), codes].reshape(len(x), -1)[:, : self.dim]
        r = x - self.coarse[cell] - scale[:, None] * direction
        packed = codes.astype(np.uint8)
        return packed[:, 0::2] << 4 | packed[:, 1::2], cell, scale, (x * (x - 2 * r)).sum(1), np.sqrt((r * r).sum(1))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Per query and pair of subspaces the 256 partial products (n x m / 2 x 256)."""
        t = np.einsum("qjs,jcs->qjc", self._cut(q), self.books)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), self.m // 2, CENTRES * CENTRES)

    def estimates(self, q: np.ndarray, columns: np.ndarray, cell: np.ndarray, scale: np.ndarray, base: np.ndarray):
        """For each query the estimated squared distances to all codes (``columns``: m / 2 x n)."""
        to_coarse, norms = q @ self.coarse.T, (q * q).sum(1)
        for i, t in enumerate(self.tables(q)):
            total = t[0].take(columns[0])
            for j in range(1, len(columns)):
                total += t[j].take(columns[j])
            yield norms[i] + base - 2 * (to_coarse[i].take(cell) + scale * total)


INDEX = "vec_id long, code binary, cell int, scale double, base double, err double"


def index(rows: DataFrame, dim: int, scratch: Scratch, sample: int = SAMPLE) -> tuple[Quantiser, DataFrame]:
    """The quantiser, and ``INDEX`` of every row of ``rows`` (vec_id, v: array of double, all ``dim`` long)."""
    # A bounded sample, dealt by hash.
    chosen = first_by_hash(rows.select("vec_id", "v"), ["vec_id"], sample).toArrow().column("v").combine_chunks()
    quantiser = Quantiser(dim).fit(_matrix(chosen).astype(float)) if len(chosen) else Quantiser(dim)

    def encode(batches):
        for b in chunks(batches, 1 << 12):
            codes, cell, scale, base, err = quantiser.encode(_matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell, pa.int32()), pa.array(scale), pa.array(base), pa.array(err)], [c.split()[0] for c in INDEX.split(", ")])

    return quantiser, scratch.written(rows.select("vec_id", "v").mapInArrow(encode, INDEX), "index")


#: Stands for no vec_id until the rows leave numpy.
OTHERS = np.iinfo(np.int64).min
FOUND = "query_id long, vec_id long, est double, b_d long, err double"


def _scan(quantiser: Quantiser, share: int, again: bool):
    """What a block of queries finds in a block of codes: the ``share`` nearest by estimate of each query, and a row without vec_id that tells the
    least estimate and the largest error of the others; or ``again``, all that could be within the query's ``far``."""

    def solve(ours, theirs):
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
        if not ours.num_rows or not theirs.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        block = theirs.column("b_d")[0].as_py()
        ids, code = theirs.column("vec_id").to_numpy(), theirs.column("code").combine_chunks()
        columns = np.ascontiguousarray(np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(ids), -1).T)
        cell, scale, base = (theirs.column(c).to_numpy() for c in ("cell", "scale", "base"))
        spread = 2 * min(1.0, ERRORS / np.sqrt(quantiser.dim)) * theirs.column("err").to_numpy()
        q, q_ids, far = _matrix(ours.column("v").combine_chunks()), ours.column("vec_id").to_numpy(), ours.column("far").to_numpy()
        found = [[], [], [], []]

        def add(query, vec, est, err):
            for x, y in zip(found, (np.full(len(vec), query), vec, est, err), strict=True):
                x.append(y)

        for a in range(0, len(q), 64):
            for i, est in enumerate(quantiser.estimates(q[a : a + 64], columns, cell, scale, base), a):
                est[q_ids[i] == ids] = np.inf
                if again:
                    some = np.flatnonzero((est - spread * far[i] <= far[i] ** 2) & (est < np.inf))
                    add(q_ids[i], ids[some], est[some], np.zeros(len(some)))
                    continue
                if len(est) > share:
                    order = np.argpartition(est, share)
                    some, others = order[:share], order[share:]
                    least = est[others].min()
                    if least < np.inf:
                        add(q_ids[i], np.array([OTHERS]), np.array([least]), np.array([spread[others].max()]))
                else:
                    some = np.arange(len(est))
                some = some[est[some] < np.inf]
                add(q_ids[i], ids[some], est[some], spread[some])
        query, vec, est, err = (np.concatenate(x) for x in found)
        arrays = [pa.array(query), pa.array(vec, mask=vec == OTHERS), pa.array(est), pa.array(np.full(len(query), block)), pa.array(err)]
        return pa.table(arrays, names)

    return solve


def _measure(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id, score: the exact distances of ``pairs`` (query_id, vec_id) on the original vectors."""
    both = pairs.join(rows.select("vec_id", "v"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def run(batches):
        for b in chunks(batches, 1 << 12):
            d = _matrix(b.column("v")) - _matrix(b.column("q"))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(_length(d))], ["query_id", "vec_id", "score"])

    return both.select("query_id", "vec_id", "v", "q").mapInArrow(run, "query_id long, vec_id long, score double")


def _length(d: np.ndarray) -> np.ndarray:
    top = np.abs(d).max(1) if d.size else np.zeros(len(d))
    if (top < LARGE).all():
        return np.sqrt((d * d).sum(1))
    top = np.maximum(top, 1e-300)
    return np.sqrt(((d / top[:, None]) ** 2).sum(1)) * top


def search(quantiser: Quantiser, indexed: DataFrame, rows: DataFrame, queries: DataFrame, k: int, scratch: Scratch, rerank: int = RERANK, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (distance) of each query's k nearest found. ``queries`` and ``rows``: vec_id, v; ``indexed``: ``INDEX`` of the rows."""
    n_d = max(1, -(-indexed.count() // data_block))
    n_q = max(1, -(-queries.count() // query_block))
    # Blocks are dealt by hash: of the nearest a block holds its share, and some more by chance.
    share = min(rerank, int(rerank / n_d + 6 * np.sqrt(rerank / n_d) + k))
    salt = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30))
    codes = indexed.select(each(F.lit(n_q)).alias("b_q"), (salt % n_d).alias("b_d"), "vec_id", "code", "cell", "scale", "base", "err").groupBy("b_q", "b_d")

    def scan(asked: DataFrame, again: bool) -> DataFrame:
        """``asked``: b_d, vec_id, v, far."""
        left = asked.select((salt % n_q).alias("b_q"), "b_d", "vec_id", "v", "far").groupBy("b_q", "b_d")
        return left.cogroup(codes).applyInArrow(_scan(quantiser, share, again), FOUND)

    every_block = queries.select("vec_id", "v", F.lit(0.0).alias("far"), each(F.lit(n_d)).alias("b_d"))
    first = scratch.written(scan(every_block, False), "scan")
    order = Window.partitionBy("query_id").orderBy("est", "vec_id")
    top = first.where("vec_id is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rerank).select("query_id", "vec_id").distinct()
    exact = scratch.written(_measure(top, rows, queries), "exact")
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kth = exact.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") == k).select("query_id", F.col("score").alias("far"))
    # What a block did not give, and what it gave but the reranking left out.
    could = F.col("est") - F.col("err") * F.col("far") <= F.col("far") ** 2
    left_out = first.join(top.withColumn("in", F.lit(True)), ["query_id", "vec_id"], "left").where("in is null").join(kth, "query_id")
    open_ = scratch.written(left_out.where(could).select(F.col("query_id").alias("vec_id"), "b_d", "far").distinct(), "open")
    if open_.limit(1).count():
        more = scan(queries.join(open_, "vec_id").select("b_d", "vec_id", "v", "far"), True)
        more = more.select("query_id", "vec_id").distinct().join(top, ["query_id", "vec_id"], "left_anti")
        exact = exact.unionByName(_measure(more, rows, queries))
    ranked = exact.distinct().withColumn("rank", F.row_number().over(nearest_first).cast("int"))
    return written(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")


def nearest(df: DataFrame, k: int = 10, every: int = 100, **how) -> DataFrame:
    """The k nearest found, among all rows of ``df`` (vec_id, embedding), of those whose vec_id is divisible by ``every``."""
    spark = df.sparkSession
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("vec_id").isNotNull() & usable("embedding") & F.exists("embedding", lambda x: x != 0)
    with Scratch(spark) as scratch:
        all_rows = scratch.written(df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), as_double.alias("v")), "vectors")
        asked = all_rows.where(F.col("vec_id") % every == 0)
        out = written(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), "nearest")
        dims, more = by_length(all_rows)
        large = [r[0] for r in all_rows.where(F.size("v").isin(dims) & F.exists("v", lambda x: F.abs(x) >= LARGE)).select(F.size("v")).distinct().collect()]
        for dim in dims:
            if dim in large:  # no estimate can be computed
                continue
            queries = asked.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
            rows = scratch.written(distinct_vectors(all_rows.where(F.size("v") == dim), "v", "vec_id", k + 1).select("vec_id", "v"), "distinct")
            quantiser, indexed = index(rows, dim, scratch)
            out = out.unionByName(search(quantiser, indexed, rows, queries, k, scratch, **how))
        if more or large:
            rest = ~F.size("v").isin([d for d in dims if d not in large])
            queries = asked.where(rest).groupBy("vec_id", F.size("v").alias("dim")).agg(F.min("v").alias("v")).select("vec_id", "v")
            rows = scratch.written(distinct_vectors(all_rows.where(rest), "v", "vec_id", k + 1), "rest")
            queries = scratch.written(queries, "asked")
            found = blocked(queries, rows, k, lambda q, x: -np.stack([_length(x - v) for v in q]), "-score", "double")
            out = out.unionByName(written(found, "nearest"))
    return out


def op3_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
