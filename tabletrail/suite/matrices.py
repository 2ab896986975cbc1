"""Matrix reshaping, alignment, z-scores and distances on the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import matrices, rows, summaries
from ..plans import row_count, staged
from .registry import Tables, query
from .statistics import LONG_SQL, long_embeddings

WIDTH = 64


@query(
    f"""SELECT feature::INT AS feature, vec_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9), 6) AS z
    FROM ({LONG_SQL}) WINDOW w AS (PARTITION BY feature)"""
)
def row_zscore_matrix(t: Tables) -> DataFrame:
    scored = matrices.row_zscores(long_embeddings(t), "feature", "value")
    return scored.select("feature", "vec_id", F.round("z", 6).alias("z"))


@query(
    """SELECT e.vec_id AS sample, e.label, l.quality, l.toxic FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id"""
)
def sample_alignment(t: Tables) -> DataFrame:
    samples = t.embeddings.select(F.col("vec_id").alias("sample"), "label")
    # Every label twice: a second, later record per sample must lose.
    labels = t.labels.select(F.col("doc_id").alias("sample"), "quality", "toxic", F.lit(0).alias("seat"))
    later = labels.withColumns({"quality": F.lit(-1), "seat": F.lit(1)})
    return matrices.align_samples(samples, summaries.stacked([labels, later]), position="seat")


@query(f"SELECT vec_id, feature::INT AS j, value FROM ({LONG_SQL})")
def matrix_long(t: Tables) -> DataFrame:
    long = matrices.long_from_arrays(t.embeddings, "vec_id", "embedding")
    return long.withColumn("value", F.col("value").cast("double"))


@query(
    """SELECT o_custkey, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') IS NOT NULL AS has_f,
        max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS "F", max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS "O",
        max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS "P",
        max(o_totalprice) FILTER (WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O', 'P')) AS rest FROM orders GROUP BY o_custkey"""
)
def matrix_wide(t: Tables) -> DataFrame:
    wide = matrices.wide_from_long(t.orders, "o_custkey", "o_orderstatus", "o_totalprice", ["F", "O", "P"], rest="rest")
    return wide.select("o_custkey", F.col("F").isNotNull().alias("has_f"), "F", "O", "P", "rest")


@query(
    """SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS sample,
        unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem"""
)
def matrix_unpivot(t: Tables) -> DataFrame:
    keyed = t.lineitem.withColumn("feature", F.struct("l_orderkey", "l_linenumber"))
    long = matrices.long_from_wide(keyed.select("feature", "l_quantity", "l_discount", "l_tax"), "feature")
    return long.select("feature.*", "sample", "value")


@query(f"""SELECT (feature + vec_id * {WIDTH})::BIGINT AS k, value, feature::BIGINT AS i, vec_id AS j FROM ({LONG_SQL})""")
def matrix_vector(t: Tables) -> DataFrame:
    samples = t.embeddings.agg(F.max("vec_id") + 1).first()[0]
    axes = [("feature", WIDTH), ("vec_id", samples)]
    vector = matrices.vector_from_matrix(long_embeddings(t), "value", axes)
    back = matrices.matrix_from_vector(vector.withColumn("kv", F.struct("k", "value")), "k", "kv", [("i", WIDTH), ("j", samples)])
    return back.select("kv.*", "i", "j")


@query(
    f"""WITH m AS ({LONG_SQL}) SELECT a.feature::BIGINT AS i, b.feature::BIGINT AS j, round(sqrt(sum(pow(a.value - b.value, 2))), 6) AS distance
    FROM m a JOIN m b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY 1, 2"""
)
def pairwise_distance(t: Tables) -> DataFrame:
    distances = matrices.position_distances(t.embeddings, "embedding", WIDTH)
    return distances.withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id, least(10, (SELECT count(*) FROM embeddings) - 1)::BIGINT AS n_near, true AS in_order FROM embeddings WHERE vec_id % 20 = 0")
def nearest_rows(t: Tables) -> DataFrame:
    """Every twentieth vector with its number of neighbours from the index, and whether they are distinct and in order.

    Which neighbours they are depends on the index; tests measure its recall against brute force.
    """
    found = rows.nearest_rows(t.embeddings, "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    # At most ten a row.
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "distance"))), lambda x: x["distance"])
    per = found.groupBy("vec_id").agg(F.count("near").alias("n_near"), F.count_distinct("near").alias("_n"), listed.alias("_d"))
    return per.select("vec_id", "n_near", ((F.col("_n") == F.col("n_near")) & (F.col("_d") == F.sort_array("_d"))).alias("in_order"))


@query("SELECT vec_id, true AS placed FROM embeddings")
def row_order(t: Tables) -> DataFrame:
    """Every vector, and whether it has a place of its own in the order of a heat map's rows.

    The order itself is checked by tests: rows of one cluster are together.
    """
    ordered = staged(rows.row_order(t.embeddings, "vec_id", "embedding"))
    taken = ordered.groupBy("position").agg(F.count(F.lit(1)).alias("_n"))
    place = (F.col("_n") == 1) & F.col("position").between(1, row_count(ordered))
    return ordered.join(taken, "position").select("vec_id", place.alias("placed"))
