"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources share ``share`` times all words by weight; a target stops at ``most``
   times its source's size and the excess is shared again by weight.
2. The volume is cut into blocks of ``block`` words. Seats go to the highest
   quotients ``target / (2 s + 1)``, so every source gets an integer quota.
3. A source is dealt over shards of about ``shard`` words by a seeded hash, and its
   quota over its shards by the same rule, so no later step needs a whole source.
4. In a shard, documents in hash order form one stream of words, cut into blocks.
   Whole rounds take every block; the rest of the quota takes the first blocks of
   a seeded permutation.

Edge cases: a null text has no words and a null source is the last source; an empty
table, or one without words, gives zero targets; repeated rows are rows of their
own; documents with equal hashes are ordered by id and size. Other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import WORD, measured, read, saved

WEIGHTS = (3, 1, 2)
SEED = "mix-1"
# A prime above any number of blocks of a shard, so that stepping by it visits every block once.
STEP = 2_147_483_647


def sizes(docs: DataFrame, seed: str = SEED, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"), *more)


def targets(volumes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, target, n_sources, total`` of rows ``source, source_size``.

    Sources reach their limit in the order of limit by weight, so one running sum over
    that order finds the level at which the rest shares. Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*map(F.lit, weights))
    named = volumes.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    rated = named.withColumn("most", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("most") / F.col("weight")).withColumn("total", total)
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # If every earlier source is at its limit, this one and those after it share the rest at this level.
    level = (F.col("total") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    stepped = rated.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    first = stepped.withColumn("turn", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("rank"))).over(everything))
    shared = F.max(F.when(F.col("rank") == F.col("turn"), F.col("level"))).over(everything)
    target = F.when(F.col("turn").isNull() | (F.col("rank") < F.col("turn")), F.col("most")).otherwise(F.col("weight") * shared)
    return first.select("source", "source_size", target.alias("target"), "total", F.count(F.lit(1)).over(everything).alias("parties"))


def seats(parties: DataFrame, group: list[str], votes: str, total: str, n_seats: Column, n_parties: str, ties: list[Column]) -> DataFrame:
    """``parties`` with ``seats``: Sainte-Lague seats within each group.

    ``total`` and ``n_parties`` name columns with the votes and parties of the group.
    A party's quota differs from its proportional share by less than one plus its
    part of the rounding of all others, half a seat each. Only seats in that range
    are contested by quotient, four per party on average, however many there are.
    """
    part = F.when(F.col(total) > 0, F.col(votes) / F.col(total)).otherwise(F.lit(0.0))
    fair = part * n_seats
    slack = F.ceil(part * F.col(n_parties) / 2) + 1
    sure = F.greatest(F.floor(fair) - slack, F.lit(0))
    open_seats = parties.withColumn("_seats", n_seats).withColumn("_sure", sure.cast("long")).withColumn("_last", (F.floor(fair) + slack).cast("long"))
    given = Window.partitionBy(*group)
    contested = open_seats.withColumn("_left", F.col("_seats") - F.sum("_sure").over(given)).where(F.col(votes) > 0).withColumn(
        "_seat", F.explode(F.sequence(F.col("_sure"), F.col("_last")))
    ).withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") + 1))
    ranked = contested.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_quotient").desc(), *ties, "_seat")))
    own = [c for c in parties.columns]
    return ranked.groupBy(*own).agg((F.min("_sure") + F.sum((F.col("_rank") <= F.col("_left")).cast("long"))).alias("seats"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = 16, shard: int = 1 << 20, seed: str = SEED, marked: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    With ``marked``, ``source`` and ``mark``, a hash of the text, follow.
    """
    more = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")] if marked else []
    rows = saved(sizes(docs, seed, *more), "sizes")
    volumes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = saved(targets(volumes, weights, share, most), "targets")
    voted = aims.withColumn("_one", F.lit(0))
    blocks = F.floor(F.col("total") / block + 0.5).cast("long")
    quotas = seats(voted, ["_one"], "target", "total", blocks, "parties", [F.col("source").asc_nulls_last()])
    split = F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)).cast("long")
    plan = aims.select("source", "source_size", "target", split.alias("shards")).alias("a").join(
        quotas.select(F.col("source").alias("_source"), "seats"), F.col("source").eqNullSafe(F.col("_source")), "left"
    ).select("source", "source_size", "target", "shards", F.coalesce("seats", F.lit(0)).alias("quota"))
    plan = measured(plan)
    known = rows.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    dealt = known.withColumn("shard", F.pmod(number, F.col("shards")))
    volumes = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("source_size", "shards", "quota")])
    shares = saved(seats(volumes, ["source"], "words", "source_size", F.col("quota"), "shards", [F.col("shard").asc()]).select("source", "shard", "words", F.col("seats").alias("shard_quota")), "quotas")
    shares = measured(shares.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "words", "shard_quota"))
    placed = dealt.join(shares, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")), "left")
    stream = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("stop", F.sum("size").over(stream)).withColumn("start", F.col("stop") - F.col("size"))
    wanted = F.least(F.col("shard_quota") * block, F.col("words") * most)
    rounds = F.floor(wanted / F.col("words"))
    placed = placed.withColumn("rounds", rounds).withColumn("rest", wanted - rounds * F.col("words")).withColumn("blocks", F.ceil(F.col("words") / block))

    def in_block(b: Column) -> Column:
        """Words of this document taken from block ``b`` in the last round."""
        rank = F.pmod(b * F.lit(STEP) + F.pmod(F.lit(STEP) - F.col("words"), F.col("blocks")), F.col("blocks"))
        first, last = b * block, (b + 1) * block
        until = F.least(last, F.col("stop"), first + F.greatest(F.col("rest") - rank * block, F.lit(0)))
        return F.greatest(until - F.greatest(first, F.col("start")), F.lit(0))

    touched = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))
    extra = F.when((F.col("rest") > 0) & (F.col("size") > 0), F.aggregate(touched, F.lit(0).cast("long"), lambda acc, b: acc + in_block(b)))
    taken = F.coalesce(F.col("size") * F.col("rounds") + F.coalesce(extra, F.lit(0)), F.lit(0)).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["source", "mark"] if marked else []))


def op4_sainte_lague_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mix(read(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``size``, ``source_size``, ``target`` and ``taken`` after their own columns.

    A column of ``docs`` with one of these names is replaced. A row is known by id, source
    and text; rows equal in all three share what they are given evenly, down to the word.
    """
    del spark, sf_dir
    key, new = ["doc_id", "source", "mark"], ["size", "source_size", "target", "taken"]
    shared = F.floor(F.sum("taken") / F.count(F.lit(1))).cast("long")
    told = mix(docs, marked=True).groupBy(*key, *new[:3]).agg(shared.alias("taken"))
    # The narrow side is the table; documents stream by unsorted.
    told = told.withColumnsRenamed({c: f"_{c}" for c in key}).hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_mark"))
    return docs.drop(*new).join(told, same, "left").drop("_doc_id", "_source", "_mark")


def _sql(block: int = 16, shard: int = 1 << 20, share: float = 1.5, most: int = 2) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
v AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM v),
r AS (SELECT *, (source_size * {most})::DOUBLE AS most, (source_size * {most})::DOUBLE / weight AS ratio, (SELECT sum(source_size) FROM v)::DOUBLE * {share}::DOUBLE AS total FROM n),
l AS (SELECT *, row_number() OVER o AS rank,
    (total - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST)),
t AS (SELECT min(rank) AS turn FROM l WHERE level <= ratio),
a AS (SELECT source, source_size, total,
    CASE WHEN turn IS NULL OR rank < turn THEN most ELSE weight * (SELECT level FROM l WHERE rank = (SELECT turn FROM t)) END AS target FROM l, t),
q AS (SELECT source, target / (2 * seat + 1) AS quotient, seat, total FROM (SELECT *, unnest(range(0, (2 * source_size // {block} + 40)::BIGINT)) AS seat FROM a WHERE target > 0)),
k AS (SELECT source, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, source ASC NULLS LAST, seat) AS place FROM q)
  WHERE place <= floor(total / {block} + 0.5) GROUP BY source),
b AS (SELECT d.*, source_size, target, coalesce(quota, 0) AS quota, ('0x' || substr(key, 1, 8))::BIGINT % greatest(ceil(source_size / {shard}), 1)::BIGINT AS shard
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
s AS (SELECT source, shard, sum(size)::BIGINT AS words, any_value(quota) AS quota FROM b GROUP BY source, shard),
sq AS (SELECT *, words / (2 * seat + 1) AS quotient FROM (SELECT *, unnest(range(0, (3 * words // {block} + 40)::BIGINT)) AS seat FROM s WHERE words > 0)),
sk AS (SELECT source, shard, count(*) AS shard_quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard, seat) AS place FROM sq)
  WHERE place <= quota GROUP BY source, shard),
p AS (SELECT b.*, words, least(coalesce(shard_quota, 0) * {block}, words * {most}) AS wanted,
    sum(size) OVER (PARTITION BY b.source, b.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop, row_number() OVER () AS row_no
  FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source AND b.shard = s.shard
  LEFT JOIN sk ON b.source IS NOT DISTINCT FROM sk.source AND b.shard = sk.shard),
w AS (SELECT *, stop - size AS start, CASE WHEN words > 0 THEN wanted // words ELSE 0 END AS rounds, CASE WHEN words > 0 THEN wanted % words ELSE 0 END AS rest, (words + {block - 1}) // {block} AS blocks FROM p),
u AS (SELECT *, unnest(range(start // {block}, (stop - 1) // {block} + 1)) AS bl FROM w WHERE rest > 0 AND size > 0),
e AS (SELECT row_no, sum(greatest(least((bl + 1) * {block}, stop, bl * {block} + greatest(rest - ((bl * {STEP} + ({STEP} - words) % blocks) % blocks) * {block}, 0)) - greatest(bl * {block}, start), 0))::BIGINT AS extra
  FROM u GROUP BY row_no)
SELECT doc_id, size, source_size, target, (size * rounds + coalesce(extra, 0))::BIGINT AS taken FROM w LEFT JOIN e USING (row_no)"""


QUERIES = {"op4_sainte_lague_mix": op4_sainte_lague_mix}
SQL = {"op4_sainte_lague_mix": _sql()}
