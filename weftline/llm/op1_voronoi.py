"""Exact top-k by inner product: a Voronoi kNN join.

Inner products become distances: with M the longest data vector, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>, so the nearest x' have the highest products.
Pivots, about sqrt(N) of them, cut this space into Voronoi cells, and every vector keeps its cell and its distance to the pivot.

* Summaries of the data's cells (size, least and largest distance, the k + 1 smallest distances) give each query an upper bound on the distance
  of its k-th neighbour, by the triangle inequality; of the queries' cells, the radius and the largest bound.
* Neighbouring cells form blocks of fixed size, of queries and of data; a cell larger than a block is dealt over several. A data vector
  goes to a block of queries only if for one of the block's cells its distance to the pivot, less the cell's radius, is within the cell's bound,
  and a query to a block of data only if the summaries let one of their cells meet.
* A block of queries and one of data are solved by visiting the data's cells in the order of their lower bounds, for 128 neighbouring
  queries at a time. Every query leaves out the cells beyond its k-th distance so far, and the visit ends when no query wants the next cell.

Where the vectors have structure, most pairs are never scored; on vectors spread evenly over a sphere of many dimensions no bound can
prune, and the join is then a blocked scan in which each vector is sent once per block of queries.

Vectors that are equal can only differ by id: per distinct vector the smallest k + 1 ids stay (a
limit that Spark applies before the shuffle), which loses nothing and takes away groups of copies.
Scores are exact: doubles where the longest query times the longest vector is below 2**53, else 64-bit integers; from 2**63 on it is an error.

Results for odd input: vectors null, empty, or holding null or non-finite components take no part; vectors of
different lengths are never compared; a repeated row counts once (of a query id's several vectors the least one asks);
a query without candidates gives no rows; an empty table gives an empty result; other columns are not read; a component or
a product that no 64-bit integer can hold raises ``ScoreOverflow``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import Scratch, chunks, first_by_hash, written

#: Pivots at most; below that there are about as many as the square root of the number of vectors.
MOST_PIVOTS = 1024
#: Components of a block of data, and queries of a block.
DATA_BLOCK, QUERY_BLOCK = 1 << 20, 1 << 13
#: Queries that visit cells together, and vectors that they score together: first few, then twice as many each time.
TOGETHER, FIRST_RUN, RUN = 128, 64, 4096
#: Vector lengths that get an index of their own, the most frequent; the others are scanned in blocks, in one plan.
LENGTHS = 8
FOUND = "query_id long, vec_id long, score long"


class ScoreOverflow(ArithmeticError):
    """Inner products that no 64-bit integer can hold."""


def usable(column: str):
    """Vectors that take part: not null or empty, all components finite."""
    inf = F.lit(float("inf"))
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf))
    return F.col(column).isNotNull() & (F.size(column) > 0) & fine


def distinct_vectors(df: DataFrame, vector: str, ident: str, keep: int) -> DataFrame:
    """Of rows with equal vectors, the ``keep`` smallest ids; repeated rows count once."""
    w = Window.partitionBy(vector).orderBy(ident)
    return df.dropDuplicates([vector, ident]).withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= keep).drop("copy")


def each(n):
    """A row for each number from 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    x = x.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]], 1)


def _flat(x: np.ndarray) -> np.ndarray:
    return np.pad(x.astype(float), ((0, 0), (0, 1)))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``scores`` the k highest, ties to the left: row and column numbers."""
    n = scores.shape[1]
    if n > 4 * k:  # all that reach the k-th highest score, ties included
        limit = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero(scores >= limit[:, None])
    else:
        rows, cols = (x.ravel() for x in np.indices(scores.shape))
    return _first(rows, cols, -scores[rows, cols], cols, k)


def _first(rows: np.ndarray, cols: np.ndarray, by: np.ndarray, then: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k entries that come first ``by``, ``then``."""
    order = np.lexsort((then, by, rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[keep], cols[keep]


def _chain(between: np.ndarray) -> np.ndarray:
    """Pivots in an order in which each is followed by the nearest that is left."""
    left, order = np.ones(len(between), bool), [0]
    left[0] = False
    while left.any():
        order.append(int(np.where(left, between[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return np.array(order)


def _deal(sizes: np.ndarray, order: np.ndarray, block: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Neighbouring cells put together into blocks: the cells of each, the block of each cell, and over how many parts a block is dealt."""
    groups, held = [[]], 0
    for c in order[sizes[order] > 0]:
        if held and held + sizes[c] > block:
            groups.append([])
            held = 0
        groups[-1].append(c)
        held += sizes[c]
    groups = [np.array(g) for g in groups if g]
    of = np.full(len(sizes), -1)
    for i, g in enumerate(groups):
        of[g] = i
    return groups, of, np.array([max(1, -(-int(sizes[g].sum()) // block)) for g in groups], int)


def knn_join(queries: DataFrame, data: DataFrame, k: int, pivots: int | None = None, data_block: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query; and how many vectors were ``scored`` for it.

    ``queries`` and ``data`` have vec_id and v (array of long, all of one length). A query's own vec_id is no candidate.
    """
    spark = data.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, scored long")
    norm = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = data.agg(norm.alias("m"), F.first(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    asked = queries.agg(norm).first()[0]
    if not size.n or asked is None:
        return none
    longest = float(size.m)
    reach = float(np.sqrt(longest) * np.sqrt(asked)) * (1 + 1e-9)  # of any partial sum too
    if reach >= 2**63:
        raise ScoreOverflow(f"products reach {reach:.3g}")
    kind = np.float64 if reach < 2**53 else np.int64
    n_pivots = pivots or min(MOST_PIVOTS, max(1, int(np.sqrt(size.n))), max(32, DATA_BLOCK // size.dim))
    block = data_block or max(1 << 10, DATA_BLOCK // size.dim)
    # A bounded sample, dealt by hash.
    chosen = first_by_hash(data.select("vec_id", "v"), ["vec_id"], n_pivots).collect()
    at = _lift(np.array([r.v for r in chosen], float), longest)
    between, slack = _to_pivots(at, at), 4e-6 * (1 + np.sqrt(longest))

    def assign(batches):
        for b in chunks(batches, 1 << 13):
            d = _to_pivots(_lift(_matrix(b.column("v")), longest), at)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "v", "cell", "dist"])

    with Scratch(spark) as scratch:
        s = scratch.written(data.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<long>, cell int, dist double"), "data")
        # Summaries: at most k + 1 rows a pivot.
        low, high, n_data = np.full(len(at), np.inf), np.full(len(at), -np.inf), np.zeros(len(at), int)
        for r in s.groupBy("cell").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n")).collect():
            low[r.cell], high[r.cell], n_data[r.cell] = r.low, r.high, r.n
        near = s.select("cell", "dist").withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("dist"))).where(F.col("n") <= k + 1).collect()
        near_cell, near_dist = np.array([r.cell for r in near]), np.array([r.dist for r in near])

        def ask(batches):
            for b in chunks(batches, 1 << 10):
                d = _to_pivots(_flat(_matrix(b.column("v"))), at)
                cell, upper = d.argmin(1), d[:, near_cell] + near_dist
                bound = (np.partition(upper, k, axis=1)[:, k] if upper.shape[1] > k else np.full(len(d), np.inf)) + slack
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell]), pa.array(bound)], ["vec_id", "v", "cell", "dist", "bound"])

        q = scratch.written(queries.select("vec_id", "v").mapInArrow(ask, "vec_id long, v array<long>, cell int, dist double, bound double"), "queries")
        radius, limit, n_query = np.zeros(len(at)), np.full(len(at), -np.inf), np.zeros(len(at), int)
        for r in q.groupBy("cell").agg(F.max("dist").alias("radius"), F.max("bound").alias("bound"), F.count("*").alias("n")).collect():
            radius[r.cell], limit[r.cell], n_query[r.cell] = r.radius, r.bound, r.n
        order = _chain(between)
        q_groups, q_of, q_parts = _deal(n_query, order, query_block)
        d_groups, d_of, d_parts = _deal(n_data, order, block)
        # Which cells the summaries let meet, and so which blocks.
        least = np.maximum(between - radius[:, None] - high, low - between - radius[:, None])
        meets = (least <= limit[:, None] + slack) & (n_query[:, None] > 0) & (n_data > 0)
        blocks_meet = np.array([[meets[np.ix_(a, b)].any() for b in d_groups] for a in q_groups])
        q_first, d_first = np.cumsum(q_parts) - q_parts, np.cumsum(d_parts) - d_parts
        names = ["b_q", "b_d", "vec_id", "v", "cell", "bound"]
        schema = "b_q int, b_d int, vec_id long, v array<long>, cell int, bound double"

        def dealt(b: pa.RecordBatch, own: np.ndarray, other: np.ndarray, first, parts, other_first, other_parts, mine: int):
            """Rows ``own`` of a batch, each to its part of its block and to every part of block ``other``."""
            salt = (b.column("salt").to_numpy()[own] % parts[mine]) + first[mine]
            for i in range(other_parts[other]):
                yield salt, np.full(len(own), other_first[other] + i), pa.array(own)

        def send_queries(batches):
            for b in chunks(batches, 1 << 12):
                group = q_of[b.column("cell").to_numpy()]
                for g in np.unique(group):
                    own = np.flatnonzero(group == g)
                    for other in np.flatnonzero(blocks_meet[g]):
                        for x, y, row in dealt(b, own, other, q_first, q_parts, d_first, d_parts, g):
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), *(b.column(c).take(row) for c in ("vec_id", "v", "cell", "bound"))], names)

        def send_data(batches):
            for b in chunks(batches, 1 << 12):
                cell = b.column("cell").to_numpy()
                group, far = d_of[cell], _to_pivots(_lift(_matrix(b.column("v")), longest), at)
                for g in np.unique(group):
                    rows = np.flatnonzero(group == g)
                    for other in np.flatnonzero(blocks_meet[:, g]):
                        c = q_groups[other]
                        wanted = ((far[np.ix_(rows, c)] - radius[c] <= limit[c] + slack) & meets[np.ix_(c, cell[rows])].T).any(1)
                        if wanted.any():
                            for x, y, row in dealt(b, rows[wanted], other, d_first, d_parts, q_first, q_parts, g):
                                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.int32()), *(b.column(c).take(row) for c in ("vec_id", "v", "cell", "dist"))], names)

        def solve(ours, theirs):
            return _solve(ours, theirs, at, longest, slack, kind, k)

        salt = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)).alias("salt")
        by = ["b_q", "b_d"]
        left = q.select("*", salt).mapInArrow(send_queries, schema).groupBy(*by)
        right = s.select("*", salt).mapInArrow(send_data, schema).groupBy(*by)
        parts = left.cogroup(right).applyInArrow(solve, f"{FOUND}, scored long")
        of_query = Window.partitionBy("query_id")
        ranked = parts.withColumn("rank", F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id")).cast("int")).withColumn("scored", F.sum("scored").over(of_query))
        return written(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored"), "top")


def _solve(ours: pa.Table, theirs: pa.Table, at: np.ndarray, longest: float, slack: float, kind, k: int) -> pa.Table:
    """The k best of a block of data for each of a block of queries; a query's first row carries the number of products."""
    names, empty = ["query_id", "vec_id", "score", "scored"], pa.array([], pa.int64())
    if not ours.num_rows or not theirs.num_rows:
        return pa.table([empty] * 4, names)
    order = np.lexsort((theirs.column("vec_id").to_numpy(), theirs.column("cell").to_numpy()))
    x, ids = _matrix(theirs.column("v").combine_chunks())[order].astype(kind), theirs.column("vec_id").to_numpy()[order]
    cell, dist = theirs.column("cell").to_numpy()[order], theirs.column("bound").to_numpy()[order]
    cells, start = np.unique(cell, return_index=True)
    end = np.append(start[1:], len(cell))
    low, high = np.minimum.reduceat(dist, start), np.maximum.reduceat(dist, start)
    mine = np.argsort(ours.column("cell").to_numpy(), kind="stable")
    qs, q_ids, bounds = _matrix(ours.column("v").combine_chunks())[mine].astype(kind), ours.column("vec_id").to_numpy()[mine], ours.column("bound").to_numpy()[mine]
    lost, out = np.iinfo(np.int64).min + 1, []
    for a in range(0, len(qs), TOGETHER):
        q, own, limit = qs[a : a + TOGETHER], q_ids[a : a + TOGETHER], bounds[a : a + TOGETHER].copy()
        d = _to_pivots(_flat(q), at[cells])
        least = np.maximum(d - high, low - d) - slack
        norm = (q.astype(float) ** 2).sum(1) + longest
        top, top_ids, scored = np.full((len(q), k), lost), np.full((len(q), k), np.iinfo(np.int64).max), np.zeros(len(q), np.int64)
        visit, n, run = np.argsort(least.min(0), kind="stable"), 0, FIRST_RUN
        while n < len(visit):
            some, held = [], 0
            while n < len(visit) and held < run and least[:, visit[n]].min() <= limit.max():
                if (least[:, visit[n]] <= limit).any():
                    some.append(visit[n])
                    held += end[visit[n]] - start[visit[n]]
                n += 1
            if not some:
                break  # no query wants this cell or, in the order of bounds, any further one
            run = min(2 * run, RUN)
            rows = np.flatnonzero((least[:, some] <= limit[:, None]).any(1))
            at_ids = np.concatenate([np.arange(start[c], end[c]) for c in some])
            at_ids = at_ids[np.argsort(ids[at_ids], kind="stable")]
            for b in range(0, len(at_ids), RUN):
                part = at_ids[b : b + RUN]
                scores = (q[rows] @ x[part].T).astype(np.int64)
                scores[own[rows][:, None] == ids[part]] = lost
                scored[rows] += len(part)
                r, c = best(scores, k)
                both = np.concatenate([np.repeat(rows, k), rows[r]])
                score, ident = np.concatenate([top[rows].ravel(), scores[r, c]]), np.concatenate([top_ids[rows].ravel(), ids[part[c]]])
                r, c = _first(both, np.arange(len(both)), -score, ident, k)
                place = np.arange(len(r)) - np.searchsorted(r, r, "left")
                top[r, place], top_ids[r, place] = score[c], ident[c]
            full = top[:, k - 1] > lost
            reached = np.sqrt(np.maximum(norm - 2 * top[:, k - 1].astype(float), 0)) + slack
            limit = np.where(full, np.minimum(limit, reached), limit)
        r, c = np.nonzero(top > lost)
        out.append((own[r], top_ids[r, c], top[r, c], np.where(c == 0, scored[r], 0)))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)


def blocked(queries: DataFrame, data: DataFrame, k: int, measure: Callable, score: str, kind: str = "long") -> DataFrame:
    """query_id, rank, vec_id, score of vectors of any lengths, compared within a length: every block of queries with every block of data.

    ``measure`` gives the scores (queries x data) of two matrices, the highest first.
    """
    salt = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30))
    sizes = data.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") * F.col("dim") / DATA_BLOCK).alias("n_d"))
    asked = queries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / QUERY_BLOCK).alias("n_q"))
    both = sizes.join(asked, "dim")
    left = queries.select(F.size("v").alias("dim"), "vec_id", "v").join(both, "dim").select("dim", (salt % F.col("n_q")).alias("b_q"), each(F.col("n_d")).alias("b_d"), "vec_id", "v")
    right = data.select(F.size("v").alias("dim"), "vec_id", "v").join(both, "dim").select("dim", each(F.col("n_q")).alias("b_q"), (salt % F.col("n_d")).alias("b_d"), "vec_id", "v")
    out_kind = pa.int64() if kind == "long" else pa.float64()

    def solve(ours, theirs):
        names = ["query_id", "vec_id", "score"]
        if not ours.num_rows or not theirs.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], out_kind)], names)
        ids = theirs.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = _matrix(theirs.column("v").combine_chunks())[order], ids[order]
        qs, q_ids, found = _matrix(ours.column("v").combine_chunks()), ours.column("vec_id").to_numpy(), []
        for a in range(0, len(qs), 64):
            scores = measure(qs[a : a + 64], x)
            own = q_ids[a : a + 64, None] == ids
            scores[own] = np.iinfo(np.int64).min + 1 if kind == "long" else -np.inf
            row, col = best(scores, k + 1)
            fine = ~own[row, col]
            row, col = row[fine], col[fine]
            found.append((q_ids[a + row], ids[col], scores[row, col]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), out_kind), strict=True)], names)

    by = ["dim", "b_q", "b_d"]
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(solve, f"query_id long, vec_id long, score {kind}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.expr(score).alias("score"))


def by_length(rows: DataFrame) -> tuple[list[int], bool]:
    """The ``LENGTHS`` most frequent lengths of v, and whether there are others."""
    found = [r[0] for r in rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(LENGTHS + 1).collect()]
    return found[:LENGTHS], len(found) > LENGTHS


def top_products(df: DataFrame, k: int = 5, every: int = 50, **how) -> DataFrame:
    """``knn_join`` of the rows of ``df`` (vec_id, embedding) whose vec_id is divisible by ``every`` with all rows, on components floor(256 x)."""
    spark = df.sparkSession
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    fine = F.col("vec_id").isNotNull() & usable("embedding")
    # A component that no long holds shows before it is cast.
    huge = F.exists("embedding", lambda x: F.abs(x.cast("double") * 256) >= float(2**63))
    with Scratch(spark) as scratch:
        all_rows = scratch.written(df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(~huge, scaled.cast("array<long>")).alias("v")), "vectors")
        if all_rows.where("v is null").limit(1).count():
            raise ScoreOverflow("a component times 256 is beyond 64-bit integers")
        out = written(spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, scored long"), "top")
        dims, more = by_length(all_rows)
        asked = all_rows.where(F.col("vec_id") % every == 0)
        for dim in dims:
            queries = asked.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
            out = out.unionByName(knn_join(queries, scratch.written(distinct_vectors(all_rows.where(F.size("v") == dim), "v", "vec_id", k + 1), "distinct"), k, **how))
        if more:
            rest = ~F.size("v").isin(dims)
            queries = asked.where(rest).groupBy("vec_id", F.size("v").alias("dim")).agg(F.min("v").alias("v")).select("vec_id", "v")
            rows = scratch.written(distinct_vectors(all_rows.where(rest), "v", "vec_id", k + 1), "rest")
            queries = scratch.written(queries, "asked")
            found = blocked(queries, rows, k, lambda q, x: q @ x.T, "score")
            out = out.unionByName(written(found, "top"), allowMissingColumns=True)
    return out


def op1_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
