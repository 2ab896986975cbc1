"""Projections, predicates, joins, aggregates, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import numbers, text
from ..operators import summaries
from ..operators.names import name_lint as lint_names
from .registry import Tables, query

MEASUREMENTS_SQL = """
    SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS sample_id, l_returnflag AS batch,
           l_linestatus AS "group", l_extendedprice AS intensity, l_discount AS p_value
    FROM lineitem
"""


def measurements(t: Tables) -> DataFrame:
    """Line items as measurements: one sample per line, batch, group, intensity, p-value."""
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"),
        F.col("l_returnflag").alias("batch"),
        F.col("l_linestatus").alias("group"),
        F.col("l_extendedprice").alias("intensity"),
        F.col("l_discount").alias("p_value"),
    )


@query(
    f"""SELECT batch, "group", count(*)::BIGINT AS n, round(avg(intensity), 4) AS mean_intensity, min(p_value) AS min_p
    FROM ({MEASUREMENTS_SQL}) GROUP BY batch, "group" ORDER BY "group", batch"""
)
def batch_stats(t: Tables) -> DataFrame:
    return summaries.summarize_batches(measurements(t))


@query(
    f"""SELECT *, row_number() OVER (ORDER BY p_value, sample_id, batch, "group", intensity)::BIGINT AS rank
    FROM ({MEASUREMENTS_SQL})"""
)
def rank_by_significance(t: Tables) -> DataFrame:
    return summaries.significance_ranks(measurements(t))


@query(
    f"""SELECT * FROM ({MEASUREMENTS_SQL}) ORDER BY p_value, sample_id, batch, "group", intensity LIMIT 10"""
)
def most_significant(t: Tables) -> DataFrame:
    return summaries.head_by(measurements(t), ["p_value", "sample_id", "batch", "group", "intensity"], 10)


@query("SELECT event_type, count(*)::BIGINT AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_counts_events(t: Tables) -> DataFrame:
    return summaries.top_counts(t.events, "event_type", 3)


@query("SELECT source, count(*)::BIGINT AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_counts_sources(t: Tables) -> DataFrame:
    return summaries.top_counts(t.documents, "source")


def _documents_and_labels(t: Tables) -> tuple[DataFrame, DataFrame]:
    # Not every document has a label.
    documents = t.documents.select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return documents, t.labels.select(F.col("doc_id").alias("id"), "quality", "toxic")


_ENRICH = """SELECT d.doc_id AS id, lang, source, n_chars, quality, toxic FROM documents d
    {} JOIN labels l ON d.doc_id = l.doc_id"""


@query(_ENRICH.format("INNER"))
def enrich_inner(t: Tables) -> DataFrame:
    return summaries.enrich(*_documents_and_labels(t), on="id")


@query(_ENRICH.format("LEFT"))
def enrich_left(t: Tables) -> DataFrame:
    return summaries.enrich(*_documents_and_labels(t), on="id", how="left")


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice,
        round((l_extendedprice - avg(l_extendedprice) OVER w) / stddev_samp(l_extendedprice) OVER w, 6) AS z_score,
        abs((l_extendedprice - avg(l_extendedprice) OVER w) / stddev_samp(l_extendedprice) OVER w) > 2 AS is_outlier
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)"""
)
def group_zscore_outliers(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    scored = summaries.group_zscores(rows, "l_returnflag", "l_extendedprice")
    return scored.withColumn("z_score", F.round("z_score", 6))


@query(
    """SELECT l_suppkey, count(*)::BIGINT AS n_rows, count(l_quantity)::BIGINT AS n, round(avg(l_quantity), 6) AS mean,
        round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd_pop
    FROM lineitem GROUP BY l_suppkey"""
)
def group_moments(t: Tables) -> DataFrame:
    moments = summaries.group_moments(t.lineitem, "l_suppkey", "l_quantity")
    return moments.select("l_suppkey", "n_rows", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "sd_pop")])


@query(
    """SELECT event_id, ts, user_id, event_type, value, props FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS seat FROM events) WHERE seat = 1"""
)
def dedup_last_wins(t: Tables) -> DataFrame:
    return summaries.last_wins(t.events, "user_id", ["ts", "event_id"])


@query(
    """SELECT event_id, ts, user_id, event_type, value, props FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seat FROM events) WHERE seat = 1"""
)
def first_match(t: Tables) -> DataFrame:
    return summaries.first_match(t.events, ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT user_id, min(event_id)::BIGINT AS event_id FROM events GROUP BY user_id ORDER BY 2")
def ordered_distinct(t: Tables) -> DataFrame:
    return summaries.ordered_distinct(t.events, "user_id", "event_id")


@query("SELECT o_orderstatus AS \"group\", o_totalprice AS value, upper(substr(o_orderpriority, 3, 3)) AS group_code FROM orders")
def stacked_groups(t: Tables) -> DataFrame:
    orders = t.orders
    status = F.col("o_orderstatus")
    known = status.eqNullSafe("F"), status.eqNullSafe("O")
    # The last frame is the rest, whatever its status.
    frames = [
        orders.filter(chosen).select(
            F.col("o_orderstatus").alias("group"),
            F.col("o_totalprice").alias("value"),
            F.upper(F.substring("o_orderpriority", 3, 3)).alias("group_code"),
        )
        for chosen in (*known, ~(known[0] | known[1]))
    ]
    return summaries.stacked(frames)


@query("SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders")
def common_customers(t: Tables) -> DataFrame:
    return summaries.common_values(t.customer.select(F.col("c_custkey").alias("key")), t.orders.select(F.col("o_custkey").alias("key")), "key")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(t: Tables) -> DataFrame:
    return summaries.difference(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id")


@query(
    """SELECT l_returnflag, count(*)::BIGINT AS n_rows, sum((l_tax IS NULL)::INT)::BIGINT AS n_missing, max((l_quantity IS NULL)::INT)::INT = 1 AS any_missing,
        count(*) FILTER (WHERE l_extendedprice > 50000 AND l_discount < 0.05)::BIGINT AS n_called,
        count(*) FILTER (WHERE l_linestatus IN ('F', 'X'))::BIGINT AS n_member
    FROM lineitem GROUP BY 1"""
)
def predicate_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(numbers.is_missing(F.col("l_tax"))).alias("n_missing"),
        F.max(numbers.is_missing(F.col("l_quantity"))).alias("any_missing"),
        F.count_if((F.col("l_extendedprice") > 50000) & (F.col("l_discount") < 0.05)).alias("n_called"),
        F.count_if(F.col("l_linestatus").isin("F", "X")).alias("n_member"),
    )


@query(
    """SELECT l_partkey, round(log2(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') / avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O')), 6) AS log_fc,
        min(l_discount) + 0.001 AS p_value, round(-log10(min(l_discount) + 0.001), 6) AS minus_log10_p,
        CASE WHEN min(l_discount) + 0.001 < 0.05 AND
          abs(log2(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') / avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O'))) > 1
          THEN 'Significant' ELSE 'Not Sig' END AS sig
    FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_linestatus) = 2"""
)
def volcano_calls(t: Tables) -> DataFrame:
    from ..operators.plots import volcano_points

    def mean_price(status: str):
        return F.avg(F.when(F.col("l_linestatus") == status, F.col("l_extendedprice")))

    effects = t.lineitem.groupBy("l_partkey").agg(
        F.log2(numbers.ratio(mean_price("F"), mean_price("O"))).alias("log_fc"), (F.min("l_discount") + 0.001).alias("p_value")
    )
    points = volcano_points(effects.filter("log_fc is not null"), adjusted="p_value")
    return points.withColumns({c: F.round(c, 6) for c in ("log_fc", "minus_log10_p")})


@query(
    """SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN '#4e79a7' WHEN 'MACHINERY' THEN '#f28e2b' END AS color FROM customer"""
)
def palette_lookup(t: Tables) -> DataFrame:
    return summaries.with_palette(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": "#4e79a7", "MACHINERY": "#f28e2b"})


@query(
    """SELECT page_id, split_part(url, '/', -1) AS base, regexp_replace(url, '/?[^/]*$', '') AS parent,
        lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) AS suffix,
        CASE WHEN starts_with(url, 'https://') THEN substr(url, 8) ELSE url END AS below_root,
        CASE WHEN ends_with(url, '.html') THEN substr(url, 1, length(url) - 5) ELSE url END AS without_html,
        'P' || CASE WHEN length(page_id::VARCHAR) >= 6 THEN page_id::VARCHAR ELSE lpad(page_id::VARCHAR, 6, '0') END AS padded
    FROM pages"""
)
def path_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select(
        "page_id",
        text.base_name(url).alias("base"),
        text.parent(url).alias("parent"),
        text.suffix(url).alias("suffix"),
        text.relative_to(url, "https:/").alias("below_root"),
        text.removed_suffix(url, ".html").alias("without_html"),
        text.padded_id("P", F.col("page_id"), 6).alias("padded"),
    )


@query(
    """SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS stripped,
        sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS code_sha256, sha256(text) AS raw_sha256
    FROM conversations"""
)
def code_hashes(t: Tables) -> DataFrame:
    value = F.col("text")
    return t.conversations.select(
        "conv_id", "turn", text.stripped(value).alias("stripped"), text.code_hash(value).alias("code_sha256"), text.sha256(value).alias("raw_sha256")
    )


@query(
    """WITH names AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT DISTINCT p_name FROM part
        UNION SELECT DISTINCT regexp_replace(url, '^https?:/', '') FROM pages UNION SELECT DISTINCT regexp_replace(url, '^.*/', '') FROM pages)
    SELECT name,
        CASE WHEN name = '' OR regexp_replace(name, '^\\s+|\\s+$', '', 'g') <> name THEN 'empty or padded'
             WHEN contains(name, '/') OR contains(name, '\\') OR starts_with(name, '.') THEN 'not flat'
             WHEN ends_with(name, '.html') THEN 'repeats suffix' END AS table_problem,
        CASE WHEN name = '' OR regexp_replace(name, '^\\s+|\\s+$', '', 'g') <> name THEN 'empty or padded'
             WHEN contains(name, '/') OR contains(name, '\\') OR starts_with(name, '.') THEN 'not flat' END AS file_problem,
        CASE WHEN NOT regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') THEN 'not an identifier' END AS unit_problem,
        CASE WHEN starts_with(name, '/') THEN 'absolute' WHEN list_contains(string_split(name, '/'), '..') THEN 'climbs out' END AS external_problem
    FROM names"""
)
def name_lint(t: Tables) -> DataFrame:
    url = F.col("url")
    names = summaries.stacked(
        [
            t.events.select(F.col("event_type").alias("name")),
            t.part.select(F.col("p_name").alias("name")),
            t.pages.select(F.regexp_replace(url, "^https?:/", "").alias("name")),
            t.pages.select(F.regexp_replace(url, "^.*/", "").alias("name")),
        ]
    ).distinct()
    return lint_names(names, "name", suffix=".html")


@query(
    r"""WITH hosts AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
    SELECT page_id, host, array_to_string(string_split(host, '.')[1:i], '.') AS ancestor
    FROM hosts, unnest(range(1, len(string_split(host, '.')))) AS u(i)"""
)
def module_ancestors(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return t.pages.select("page_id", host.alias("host")).withColumn("ancestor", F.explode(text.ancestors(F.col("host"))))


@query(
    """SELECT event_id, (props->>'k')::INT AS k, '{"event_type":"' || event_type || '","k":' || (props->>'k') || '}' AS sidecar FROM events"""
)
def props_json(t: Tables) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct("event_type", k.alias("k"))).alias("sidecar"))


@query(
    """SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS day, strftime(o_orderdate, '%Y-%m-%d') AS date_text,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS datetime_text, o_orderdate::DATE AS back FROM orders"""
)
def epoch_day_dates(t: Tables) -> DataFrame:
    day = text.epoch_day(F.col("o_orderdate").cast("date"))
    return t.orders.select(
        "o_orderkey",
        day.alias("day"),
        text.date_text(F.col("o_orderdate")).alias("date_text"),
        text.datetime_text(F.col("o_orderdate")).alias("datetime_text"),
        text.from_epoch_day(day).alias("back"),
    )


@query(
    """SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ', ') AS kinds, count(DISTINCT event_type)::INT AS n_kinds,
        CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS only_kind
    FROM events GROUP BY user_id"""
)
def joined_lists(t: Tables) -> DataFrame:
    # A set of event types is bounded by the number of types.
    kinds = F.sort_array(F.collect_set("event_type"))
    listed = t.events.groupBy("user_id").agg(kinds.alias("_k"))
    scalar, _ = numbers.scalar_or_array(F.col("_k"))
    return listed.select("user_id", text.joined(F.col("_k")).alias("kinds"), F.size("_k").alias("n_kinds"), scalar.alias("only_kind"))
