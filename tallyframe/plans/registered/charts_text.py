"""Chart frames, text tables and structured requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fixed
from tallyframe.operators import charts, text_tables
from tallyframe.operators.metrics import Metric
from tallyframe.functions.periods import period_label
from tallyframe.plans.registered.base import query, rounded, table
from tallyframe.plans.registered.ranking import nested_sql
from tallyframe.plans.request import analyze

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "chart_series",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, {', '.join(
        f"round(sum(CASE WHEN event_type = '{t}' THEN value END), 2) AS {t}" for t in EVENT_TYPES)} FROM events GROUP BY 1""",
)
def chart_series(spark, sf):
    events = table(spark, sf, "events").withColumn("day", period_label(F.col("ts"), "day"))
    return rounded(charts.chart_series(events, "day", Metric("value"), "event_type", EVENT_TYPES), 2, *EVENT_TYPES)


@query(
    "scatter_sample",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, greatest((SELECT count(*) FROM lineitem) - 1000, 0) AS left_out
       FROM lineitem ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey)), l_orderkey, l_linenumber, l_partkey LIMIT 1000""",
)
def scatter_sample(spark, sf):
    lines = table(spark, sf, "lineitem")
    return charts.scatter_sample(lines, ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "split_segments",
    r"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS segment_number, segment FROM (
          SELECT conv_id, turn, i, trim(regexp_replace(trim(regexp_replace(piece, '\s+', ' ', 'g')),
                 '^(?:[-*•]\s*|\d+[\.\)]\s*|[a-zA-Z][\.\)]\s*)', '')) AS segment
          FROM (SELECT conv_id, turn, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i
                FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[;\n]+') AS pieces FROM conversations)))
        WHERE segment <> ''""",
)
def split_segments(spark, sf):
    return text_tables.split_segments(table(spark, sf, "conversations"), "text", ["conv_id", "turn"])


@query(
    "conversation_context",
    """SELECT conv_id, turn, role FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS again FROM (
           SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations WHERE length(text) >= 40)
         WHERE rk <= 6 AND role <> 'system') WHERE again <= 4""",
)
def conversation_context(spark, sf):
    turns = table(spark, sf, "conversations")
    return text_tables.conversation_context(
        turns, "conv_id", "turn", succeeded=F.length("text") >= 40, same_scope=F.col("role") != "system"
    ).select("conv_id", "turn", "role")


STOP = ", ".join(f"'{w}'" for w in fixed.MATCH_STOP_WORDS)
TOKENS = f"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains([{STOP}], w)))"


@query(
    "fuzzy_catalogue_match",
    f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS a FROM conversations), b AS (SELECT item_id, {TOKENS} AS c FROM benchmark),
          s AS (SELECT conv_id, turn, item_id, len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c))) AS score
                FROM t, b WHERE len(list_intersect(a, c)) > 0),
          m AS (SELECT *, max(score) OVER (PARTITION BY conv_id, turn) AS best FROM s)
        SELECT conv_id, turn, item_id, score, count(*) OVER (PARTITION BY conv_id, turn) > 1 AS is_ambiguous
        FROM m WHERE best >= 0.2 AND score >= best * 0.8""",
)
def fuzzy_catalogue_match(spark, sf):
    return text_tables.fuzzy_catalogue_match(
        table(spark, sf, "conversations"), "text", ["conv_id", "turn"], table(spark, sf, "benchmark"), "item_id", "text"
    )


@query(
    "analyze_nested_ranking",
    nested_sql("DESC", 3, 2).replace("FROM lineitem", "FROM (SELECT * FROM lineitem WHERE lower(l_returnflag) = 'r' AND l_quantity >= 10)"),
)
def analyze_nested_ranking(spark, sf):
    result = analyze(table(spark, sf, "lineitem"), {
        "operation": "top", "metrics": ["l_extendedprice"], "ranking_levels": [("l_suppkey", 3), ("l_partkey", 2)],
        "filters": [{"field": "l_returnflag", "operator": "equals", "value": "R"},
                    {"field": "l_quantity", "operator": "greater_than_or_equal", "value": 10}],
    })
    return rounded(result, 2, "outer_value", "inner_value")


@query(
    "analyze_grouped_total",
    """SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue,
              count(DISTINCT o_custkey) AS customers FROM orders
       WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY 1, 2""",
)
def analyze_grouped_total(spark, sf):
    result = analyze(table(spark, sf, "orders"), {
        "operation": "total", "metrics": [Metric("o_totalprice", name="revenue"), Metric("o_custkey", "nunique", "customers")],
        "group_by": ["o_orderpriority"], "granularity": "month", "date_column": "o_orderdate",
        "filters": {"date_from": "1997-01-01"},
    })
    return rounded(result, 2, "revenue")
