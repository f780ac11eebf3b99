"""Temperature mixing of sources, realised as budgeted block permutations. DataFrame functions only.

Each source's share of the tokens is raised to an exponent and normalised. The exponent is bisected until the mixture
meets a target: the steepest mixture that still has ``entropy`` bits, or the flattest in which no source is repeated more than
``max_repeats`` times. The token budget is given, or ("cover") it is the smallest that passes
every source once, so that no document is lost. A round of the bisection evaluates a grid of exponents in one
aggregation over the sources, which stay distributed.

A source with r repeats gives floor(r) full passes, and a part of one more. Its documents fall into
``BLOCKS`` blocks by hash. Each pass has its own permutation of the blocks; the part takes blocks
in that order while they fit the rest of the budget, and then documents of the next block, by
hash, while they fit. So all that a row needs is its source's cut-off: a block's hash and a document's.
Sums per (source, block) are made before any shuffle, so a source with a third of all rows is
``BLOCKS`` rows like any other. ``position`` puts the passes of all sources in one order
in which every part of the mixture has the same proportions.

Results for odd input: a null source is a source of its own; a null text has no words; a document
without words stays in full passes; documents with equal doc_ids share their fate; a null doc_id hashes as an empty one;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import written

BLOCKS = 1024
#: First digits of a hash that divide a block further.
LEAD = 3
GRID, ROUNDS = 32, 6
MAX_REPEATS = 2.0
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Sources that are joined by broadcast at most; beyond that the join shuffles.
BROADCAST_SOURCES = 100_000


def _hex_number(digits):
    """The number that eight hex digits write."""
    return F.conv(digits, 16, 10).cast("long")


def _doc_hash():
    return F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _block(doc_hash, blocks: int):
    return (_hex_number(F.substring(doc_hash, 1, 8)) % blocks).cast("int")


def _turn(source_key, block, epoch):
    """The place of a block in a source's permutation for one pass."""
    return F.md5(F.concat_ws("|", source_key, block.cast("string"), epoch.cast("string")).cast("binary"))


def _key():
    """Text that tells sources apart, null included."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def exponent(shares: DataFrame, max_repeats: float | None, entropy: float | None, budget: float | None) -> float:
    """The exponent in [0, 1] of the flattest mixture within ``max_repeats``, or of the steepest one that has ``entropy`` bits.

    ``shares`` has a row per source with ``p``, its share of the tokens. With ``budget`` None it covers every source once.
    """
    ends = shares.agg(F.max("p").alias("top"), F.min("p").alias("least"), F.sum("p").alias("all")).first()
    if not ends.top:
        return 1.0
    lo, hi = 0.0, 1.0

    def meets(r, i) -> bool:
        z = r[f"z{i}"]
        if entropy is not None:
            return r[f"e{i}"] >= entropy - 1e-9
        a = grid[i]
        if budget is None:
            return (ends.top / ends.least) ** (1 - a) <= max_repeats * (1 + 1e-12)
        return ends.least ** (a - 1) / z * budget <= max_repeats * (1 + 1e-12)

    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
        sums = [F.sum(F.pow("p", F.lit(a))).alias(f"z{i}") for i, a in enumerate(grid)]
        r = shares.agg(*sums).first()
        if entropy is not None:
            w = [F.pow("p", F.lit(a)) / F.lit(r[f"z{i}"]) for i, a in enumerate(grid)]
            r = r.asDict() | shares.agg(*[F.sum(-x * F.log2(x)).alias(f"e{i}") for i, x in enumerate(w)]).first().asDict()
        else:
            r = r.asDict()
        # Entropy falls as the exponent grows, repeats of the smallest source fall too: so
        # the entropy target is met up to some exponent, and the repeat limit from some exponent on.
        fine = [i for i in range(GRID + 1) if meets(r, i)]
        if entropy is not None:
            if not fine:
                return lo
            at = max(fine)
            lo, hi = grid[at], grid[min(at + 1, GRID)]
        else:
            if not fine:
                return 1.0
            at = min(fine)
            lo, hi = grid[max(at - 1, 0)], grid[at]
    return lo if entropy is not None else hi


def schedule(narrow: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: int | None = None, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The sources and their blocks, from written rows ``narrow`` (key, doc_hash, n_tokens).

    Sources: key, tokens, weight, repeats, full (passes), and for the part of a pass cut_turn and
    cut_doc. Blocks: key, block, epoch, place (0 to 1 within the pass).
    """
    per_block = written(narrow.groupBy("key", _block(F.col("doc_hash"), blocks).alias("block")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "blocks")
    sources = per_block.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = written(sources.select("key", "tokens", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("p")), "shares")
    used = shares.where("tokens > 0")
    alpha = exponent(used.select("p"), max_repeats, entropy, budget / total if budget is not None and total else None)
    z, top = used.agg(F.sum(F.pow("p", F.lit(alpha))), F.max("p")).first()
    weight = F.pow("p", F.lit(alpha)) / F.lit(z or 1.0)
    repeats = F.pow(F.lit(top or 1.0) / F.col("p"), F.lit(1 - alpha)) if budget is None else weight * F.lit(float(budget)) / F.col("tokens")
    sources = shares.withColumn("weight", F.when(F.col("tokens") > 0, F.round(weight, 9)).otherwise(0.0)).withColumn("repeats", F.when(F.col("tokens") > 0, F.round(repeats, 9)).otherwise(1.0))
    sources = sources.withColumn("full", F.floor("repeats").cast("int")).withColumn("rest", F.floor((F.col("repeats") - F.col("full")) * F.col("tokens")).cast("long"))
    epochs = F.sequence(F.lit(0), F.col("full"))  # the last is the part of a pass
    turned = per_block.join(sources.select("key", "full", "rest"), "key").withColumn("epoch", F.explode(epochs)).withColumn("turn", _turn(F.col("key"), F.col("block"), F.col("epoch")))
    w = Window.partitionBy("key", "epoch").orderBy("turn")
    turned = turned.withColumn("upto", F.sum("tokens").over(w)).withColumn("place", (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy("key", "epoch")))
    turned = written(turned, "turns")
    # The first block that no longer fits, and how much of it does.
    cut = turned.where("epoch = full and upto > rest").groupBy("key").agg(F.min(F.struct("turn", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))).alias("c")).select("key", "c.*")
    inside = narrow.withColumn("block", _block(F.col("doc_hash"), blocks)).join(cut, ["key", "block"])
    by_hash = inside.groupBy("key", "room", "doc_hash").agg(F.sum("n_tokens").alias("n"))
    by_hash = written(by_hash.withColumn("lead", F.substring("doc_hash", 1, LEAD)), "cut-block")
    # Hashes in order, in two steps: sums by their first digits say where the room ends, and only those hashes are summed one by one.
    by_lead = by_hash.groupBy("key", "room", "lead").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("lead")))
    end = by_lead.where("upto > room").groupBy("key").agg(F.min(F.struct("lead", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select("key", F.col("e.lead").alias("end"), "e.before")
    near_end = by_hash.join(end, "key")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("key").orderBy("doc_hash"))
    at_end = near_end.where(F.col("lead") == F.col("end")).withColumn("upto", upto).where("upto <= room").select("key", "doc_hash")
    last = near_end.where(F.col("lead") < F.col("end")).select("key", "doc_hash").unionByName(at_end).groupBy("key").agg(F.max("doc_hash").alias("cut_doc"))
    sources = sources.join(cut.select("key", F.col("turn").alias("cut_turn")), "key", "left").join(last, "key", "left")
    return written(sources.drop("p"), "sources"), turned.select("key", "block", "epoch", "place")


def passes(rows: DataFrame, sources: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``row`` (the columns of ``rows``, which has source and doc_id), once for each pass that has it, with key, block and epoch."""
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), _key().alias("key"), _doc_hash().alias("doc_hash"))
    keyed = keyed.withColumn("block", _block(F.col("doc_hash"), blocks))
    turn = _turn(F.col("key"), F.col("block"), F.col("full"))
    # No cut: the whole rest fits, which is so only if nothing is left over.
    part = (F.col("rest") > 0) & (F.col("cut_turn").isNull() | (turn < F.col("cut_turn")) | ((turn == F.col("cut_turn")) & (F.col("doc_hash") <= F.coalesce("cut_doc", F.lit("")))))
    listed = sources.select("key", "full", "rest", "cut_turn", "cut_doc")
    joined = keyed.join(F.broadcast(listed) if few else listed, "key")
    times = joined.withColumn("times", F.col("full") + F.when(part, 1).otherwise(0)).where("times > 0")
    return times.select("row", "key", "block", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))


def narrow_rows(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """key, source, doc_id, doc_hash, n_tokens of ``docs``: the column ``tokens``, where one is named (token counts, say; null is 0), else words."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)) if tokens is None else F.col(f"`{tokens}`"), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", _key().alias("key"), _doc_hash().alias("doc_hash"), words.alias("n_tokens"))


def mix(docs: DataFrame, tokens: str | None = None, **how) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, weight, repeats, position: the mixture's rows."""
    narrow = written(narrow_rows(docs, tokens), "narrow")
    sources, places = schedule(narrow, **how)
    found = passes(narrow, sources).select("row.doc_id", "row.source", "row.n_tokens", "key", "block", "epoch")
    found = found.join(places, ["key", "block", "epoch"]).join(sources.select("key", "weight", "repeats"), "key")
    position = F.round((F.col("epoch") + F.col("place")) / F.greatest("repeats", F.lit(1e-9)), 6)
    return found.select("doc_id", "source", "n_tokens", "epoch", "block", F.round("weight", 6).alias("weight"), F.round("repeats", 6).alias("repeats"), position.alias("position"))


def mixed_documents(docs: DataFrame, tokens: str | None = None, **how) -> DataFrame:
    """The rows of ``docs``, once for each pass of the mixture that has them."""
    sources, _ = schedule(written(narrow_rows(docs, tokens), "narrow"), **how)
    return passes(docs, sources).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rounds = []
    prev = "(SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)"
    for r in range(ROUNDS):
        grid = f"SELECT i, lo, hi, lo + (hi - lo) * i / {GRID} AS a FROM {prev}, range({GRID + 1}) t(i)"
        fine = f"SELECT min(i) AS first_i, any_value(lo) AS lo, any_value(hi) AS hi FROM g{r}, ends WHERE pow(top / least, 1 - a) <= {MAX_REPEATS} * (1 + 1e-12)"
        rounds.append(f"g{r} AS ({grid}), f{r} AS ({fine}), r{r} AS (SELECT lo + (hi - lo) * greatest(first_i - 1, 0) / {GRID} AS lo, lo + (hi - lo) * first_i / {GRID} AS hi FROM f{r})")
        prev = f"r{r}"
    return f"""
WITH n AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, md5('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents
), d AS (SELECT *, (('0x' || substr(h, 1, 8))::BIGINT % {BLOCKS})::INTEGER AS block FROM n),
b AS (SELECT key, block, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY key, block),
s0 AS (SELECT key, sum(tokens)::BIGINT AS tokens FROM b GROUP BY key),
s1 AS (SELECT key, tokens, tokens / greatest((SELECT sum(tokens) FROM s0), 1)::DOUBLE AS p FROM s0),
ends AS (SELECT max(p) AS top, min(p) AS least FROM s1 WHERE tokens > 0),
{", ".join(rounds)},
al AS (SELECT hi AS a FROM r{ROUNDS - 1}),
z AS (SELECT sum(pow(p, a)) AS z FROM s1, al WHERE tokens > 0),
s2 AS (SELECT key, tokens, CASE WHEN tokens > 0 THEN round(pow(p, a) / z, 9) ELSE 0 END AS weight,
       CASE WHEN tokens > 0 THEN round(pow(top / p, 1 - a), 9) ELSE 1 END AS repeats FROM s1, al, z, ends),
s3 AS (SELECT *, floor(repeats)::INTEGER AS full_, floor((repeats - floor(repeats)) * tokens)::BIGINT AS rest FROM s2),
t AS (SELECT b.key, b.block, b.tokens, s3.full_, s3.rest, e.epoch::INTEGER AS epoch, md5(concat_ws('|', b.key, b.block::VARCHAR, e.epoch::VARCHAR)) AS turn
      FROM b JOIN s3 USING (key), LATERAL (SELECT unnest(range(s3.full_ + 1)) AS epoch) e),
t2 AS (SELECT *, sum(tokens) OVER (PARTITION BY key, epoch ORDER BY turn) AS upto,
       (row_number() OVER (PARTITION BY key, epoch ORDER BY turn) - 1) / count(*) OVER (PARTITION BY key, epoch)::DOUBLE AS place FROM t),
c AS (SELECT key, min(turn) AS cut_turn, arg_min(block, turn) AS block, arg_min(rest - upto + tokens, turn) AS room FROM t2 WHERE epoch = full_ AND upto > rest GROUP BY key),
u AS (SELECT key, h, room, sum(sum(n_tokens)) OVER (PARTITION BY key ORDER BY h) AS upto FROM d JOIN c USING (key, block) GROUP BY key, h, room),
l AS (SELECT key, max(h) AS cut_doc FROM u WHERE upto <= room GROUP BY key),
m AS (SELECT d.*, s3.full_, s3.weight, s3.repeats,
      s3.full_ + CASE WHEN s3.rest > 0 AND (c.cut_turn IS NULL OR t2.turn < c.cut_turn OR (t2.turn = c.cut_turn AND d.h <= coalesce(l.cut_doc, ''))) THEN 1 ELSE 0 END AS times
      FROM d JOIN s3 USING (key) JOIN t2 ON t2.key = d.key AND t2.block = d.block AND t2.epoch = s3.full_
      LEFT JOIN c ON c.key = d.key LEFT JOIN l ON l.key = d.key)
SELECT m.doc_id, m.source, m.n_tokens, t2.epoch, m.block, round(m.weight, 6) AS weight, round(m.repeats, 6) AS repeats,
       round((t2.epoch + t2.place) / greatest(m.repeats, 1e-9), 6) AS position
FROM m JOIN t2 ON t2.key = m.key AND t2.block = m.block AND t2.epoch < m.times
"""


SQL = _sql()
