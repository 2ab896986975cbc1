"""Typed exchange of tables, factors, dates and lists."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, functions as F

from ..functions import numbers
from ..operators import exchange, usercode
from .registry import Tables, query


@query(
    """SELECT o_orderkey::INT AS o_orderkey, (o_orderkey * 1000000000)::DOUBLE AS big, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price,
        o_orderstatus AS "order status", o_orderdate::DATE AS "order-date", o_totalprice > 250000 AS large FROM orders"""
)
def exchange_orders(t: Tables) -> DataFrame:
    nan = F.lit(float("nan"))
    table = t.orders.select(
        "o_orderkey",
        (F.col("o_orderkey") * 1000000000).alias("big"),  # beyond 32 bits at every scale
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).otherwise(nan).alias("price"),
        F.col("o_orderstatus").alias("order status"),
        F.col("o_orderdate").cast("date").alias("order-date"),
        (F.col("o_totalprice") > 250000).alias("large"),
    )
    return exchange.to_exchange(table)


@query(
    """WITH levels AS (SELECT event_type, row_number() OVER (ORDER BY event_type)::BIGINT AS code FROM (SELECT DISTINCT event_type FROM events))
    SELECT event_id, code, event_type AS label, CASE WHEN code <= 3 THEN event_type END AS known FROM events JOIN levels USING (event_type)"""
)
def factor_decode(t: Tables) -> DataFrame:
    coded, levels = exchange.factor_codes(t.events.select("event_id", "event_type"), "event_type", "code")
    coded = coded.drop("event_type").withColumn("code_copy", F.col("code"))
    decoded = exchange.decode_factor(coded, "code", levels.withColumnRenamed("event_type", "label"), "label")
    # The three first levels given as a plain list: later codes have no label.
    known = numbers.level_label(F.array(F.lit("click"), F.lit("error"), F.lit("purchase")), F.col("code_copy"))
    return decoded.select("event_id", F.col("code_copy").alias("code"), "label", known.alias("known"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, CASE WHEN l_tax < 0.05 THEN l_tax END AS l_tax FROM lineitem")
def exchange_back(t: Tables) -> DataFrame:
    nan = F.lit(float("nan"))
    coded = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.unix_date(F.col("l_shipdate").cast("date")).cast("double").alias("day"),
        F.when(F.col("l_tax") < 0.05, F.col("l_tax")).otherwise(nan).alias("l_tax"),
    )
    return exchange.from_exchange(coded, dates=("day",))


_ELEMENTS_SQL = """SELECT user_id || CASE WHEN event_type IN ('click', 'view') THEN ':num' WHEN event_type = 'error' THEN '' ELSE ':' || event_type END AS list_id,
    CASE event_type WHEN 'click' THEN 'integer' WHEN 'view' THEN 'double' WHEN 'signup' THEN 'boolean' WHEN 'error' THEN
      CASE WHEN value > 50 THEN 'null' ELSE 'boolean' END ELSE 'string' END AS type,
    CASE event_type WHEN 'click' THEN props->>'k' WHEN 'view' THEN value::VARCHAR WHEN 'signup' THEN 'true' WHEN 'error' THEN
      CASE WHEN value > 50 THEN NULL ELSE 'false' END ELSE props END AS value, event_id FROM events"""


def _elements(t: Tables) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    list_name = F.when(kind.isin("click", "view"), ":num").when(kind == "error", "").otherwise(F.concat(F.lit(":"), kind))
    failed = F.when(F.col("value") > 50, "null").otherwise("boolean")
    type_name = F.when(kind == "click", "integer").when(kind == "view", "double").when(kind == "signup", "boolean")
    text = F.when(kind == "click", F.get_json_object("props", "$.k")).when(kind == "view", F.col("value").cast("string"))
    return t.events.select(
        F.concat(user, list_name).alias("list_id"),
        type_name.when(kind == "error", failed).otherwise("string").alias("type"),
        text.when(kind == "signup", "true").when(kind == "error", F.when(F.col("value") <= 50, "false")).otherwise(F.col("props")).alias("value"),
        "event_id",
    )


_VECTORS_SQL = f"""SELECT list_id, count(*)::BIGINT AS length,
    CASE WHEN count(*) FILTER (WHERE type <> 'null') = 0 THEN 'boolean'
      WHEN count(*) FILTER (WHERE type = 'boolean') = count(*) FILTER (WHERE type <> 'null') THEN 'boolean'
      WHEN count(*) FILTER (WHERE type = 'integer') = count(*) FILTER (WHERE type <> 'null') THEN 'integer'
      WHEN count(*) FILTER (WHERE type IN ('integer', 'double')) = count(*) FILTER (WHERE type <> 'null') THEN 'double'
      WHEN count(*) FILTER (WHERE type = 'string') = count(*) FILTER (WHERE type <> 'null') THEN 'string' ELSE 'list' END AS vector_type
    FROM ({_ELEMENTS_SQL}) GROUP BY list_id"""


@query(_VECTORS_SQL)
def vector_types(t: Tables) -> DataFrame:
    return exchange.vector_types(_elements(t))


@query(
    f"""SELECT event_id, list_id, vector_type, length = 1 AS is_scalar,
        CASE WHEN vector_type = 'boolean' THEN value::BOOLEAN END AS as_boolean,
        CASE WHEN vector_type = 'integer' THEN value::INT END AS as_integer,
        CASE WHEN vector_type = 'double' THEN value::DOUBLE END AS as_double,
        CASE WHEN vector_type = 'string' THEN value END AS as_string
    FROM ({_ELEMENTS_SQL}) JOIN ({_VECTORS_SQL}) USING (list_id)"""
)
def typed_elements(t: Tables) -> DataFrame:
    columns = ["event_id", "list_id", "vector_type", "is_scalar", "as_boolean", "as_integer", "as_double", "as_string"]
    return exchange.typed_elements(_elements(t)).select(*columns)


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def nested_props(t: Tables) -> DataFrame:
    return exchange.parse_nested(t.events.select("event_id", "props"), "props").select("event_id", F.col("parsed.k").alias("k"))


@query(
    """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'named' ELSE 'positional' END AS form, CASE WHEN s_acctbal > 0 THEN s_name END AS by_name,
        CASE WHEN s_acctbal <= 0 THEN s_name END AS by_position FROM supplier"""
)
def named_lists(t: Tables) -> DataFrame:
    names = F.array(F.lit("id"), F.when(F.col("s_acctbal") > 0, "name").otherwise(""))
    values = F.array(F.col("s_suppkey").cast("string"), F.col("s_name"))
    named, positional = exchange.named_list(names, values), exchange.positional_list(names, values)
    return t.supplier.select("s_suppkey", named.alias("m"), positional.alias("p")).select(
        "s_suppkey",
        F.when(F.col("m").isNotNull(), "named").otherwise("positional").alias("form"),
        F.try_element_at("m", F.lit("name")).alias("by_name"),
        F.try_element_at("p", F.lit(2)).alias("by_position"),
    )


@query(
    """SELECT l_returnflag, l_orderkey, l_linenumber, round(l_extendedprice / 100, 6) AS scaled FROM lineitem"""
)
def user_code_over_table(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")

    def scale(batch):
        batch["scaled"] = (batch.pop("l_extendedprice") / 100).round(6)
        return batch

    out = exchange.map_table(rows, scale, "l_returnflag string, l_orderkey int, l_linenumber int, scaled double")
    return out.withColumn("l_orderkey", F.col("l_orderkey").cast("bigint")).withColumn("scaled", F.round("scaled", 6))


@query("SELECT o_custkey, o_orderkey, round(max(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice, 2) AS below_largest FROM orders")
def user_code_over_groups(t: Tables) -> DataFrame:
    """User code that sees a group in parts and merges what it made of them."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")

    def partial(orders):
        return struct.pack("d", orders["o_totalprice"].max())

    def finish(state):
        return struct.unpack("d", state)

    largest = usercode.with_group_results(rows, ["o_custkey"], partial, max_state, finish, "largest double")
    return largest.select("o_custkey", "o_orderkey", F.round(F.col("largest") - F.col("o_totalprice"), 2).alias("below_largest"))


def max_state(a: bytes, b: bytes) -> bytes:
    return max(a, b, key=lambda state: struct.unpack("d", state))


_FACTS = """SELECT '{0}.{1}' AS name, '{2}' AS base, count(*)::BIGINT AS rows, count(*) FILTER (WHERE {1} IS NULL)::BIGINT AS missing, {3}::VARCHAR AS refusal FROM {0}"""
_FLATTEN = "'flatten it first (matrices go through matrix operators, records through nested ones)'"
_CAST = "'cast it to a string, a number or a date first'"
_EXPECTED = [
    ("embeddings", "vec_id", "bigint", "NULL"), ("embeddings", "embedding", "array", _FLATTEN), ("embeddings", "label", "int", "NULL"),
    ("events", "event_id", "bigint", "NULL"), ("events", "ts", "timestamp_ntz", _CAST), ("events", "user_id", "bigint", "NULL"), ("events", "event_type", "string", "NULL"),
    ("events", "value", "double", "NULL"), ("events", "props", "string", "NULL"),
]


@query(" UNION ALL ".join(_FACTS.format(*row) for row in _EXPECTED))
def exchange_report(t: Tables) -> DataFrame:
    """Which columns of two tables would be refused, and how many cells are missing."""
    reports = [exchange.exchange_report(table).withColumn("name", F.concat(F.lit(f"{name}."), "name")) for name, table in (("embeddings", t.embeddings), ("events", t.events))]
    return reports[0].unionByName(reports[1])
