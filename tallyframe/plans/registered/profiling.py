"""Column profiles, catalogue and dataset statistics over every kind of table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.operators import catalogue, profile
from tallyframe.plans.registered.base import query, rounded, table

# Column name and kind per table, for generating the SQL side.
COLUMNS = {
    "customer": {"c_custkey": "numeric", "c_name": "text", "c_nationkey": "numeric", "c_acctbal": "numeric",
                 "c_mktsegment": "text"},
    "part": {"p_partkey": "numeric", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "numeric",
             "p_retailprice": "numeric"},
    "orders": {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "text", "o_totalprice": "numeric",
               "o_orderdate": "datetime", "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
                 "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
                 "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "datetime"},
    "events": {"event_id": "numeric", "ts": "datetime", "user_id": "numeric", "event_type": "text",
               "value": "numeric", "props": "text"},
    "documents": {"doc_id": "numeric", "text": "text", "lang": "text", "source": "text", "n_chars": "numeric"},
    "labels": {"doc_id": "numeric", "quality": "numeric", "toxic": "numeric"},
}


def _column_sql(source, name, kind):
    numeric, text, time = kind == "numeric", kind == "text", kind == "datetime"
    null = "CAST(NULL AS DOUBLE)"
    step = f"""(SELECT avg(CAST(d = 1 AS INT)) FROM (SELECT v - lag(v) OVER (ORDER BY v) AS d FROM (
        SELECT DISTINCT {name} AS v FROM {source} WHERE {name} IS NOT NULL)))"""
    return f"""SELECT '{name}' AS c, '{kind}' AS kind, count(*) AS row_count, count({name}) AS nn,
      count(DISTINCT {name}) AS u,
      {f'min({name}) + 0.0' if numeric else null} AS mn, {f'max({name}) + 0.0' if numeric else null} AS mx,
      {f'avg({name})' if numeric else null} AS mean, {f'median({name})' if numeric else null} AS med,
      {f'stddev_samp({name})' if numeric else null} AS std,
      {f'avg(CAST({name} < 0 AS INT))' if numeric else null} AS neg, {f'avg(CAST({name} = 0 AS INT))' if numeric else null} AS zero,
      {f'bool_and({name} % 1 = 0)' if numeric else 'NULL'} AS whole, {f'bool_and({name} IN (0, 1))' if numeric else 'NULL'} AS bits,
      {f'avg(CAST({name} BETWEEN 0 AND 1 AS INT))' if numeric else null} AS unit, {step if numeric else null} AS step,
      {f'''avg(CAST(lower({name}) IN ('true','false','yes','no','y','n','0','1') AS INT))''' if text else null} AS words,
      {f'avg(CAST(coalesce(year(TRY_CAST({name} AS TIMESTAMP)) BETWEEN 1900 AND 2100, false) AS INT)) FILTER (WHERE {name} IS NOT NULL)' if text else ('1.0' if time else '0.0')} AS dates,
      {f'min({name})' if time else 'CAST(NULL AS TIMESTAMP)'} AS t0, {f'max({name})' if time else 'CAST(NULL AS TIMESTAMP)'} AS t1,
      {str(profile.name_has(name, profile.NameHints().identifier)).lower()} AS id_name,
      {str(profile.strong_identifier_name(name)).lower()} AS strong_name,
      {str(profile.name_has(name, profile.NameHints().monetary)).lower()} AS money_name,
      {str(profile.name_has(name, profile.NameHints().percentage)).lower()} AS pct_name,
      {str(profile.name_has(name, profile.NameHints().geographic)).lower()} AS geo_name
    FROM {source}"""


def half_up(expression):
    """Four places, rounded half up on the decimal value as Spark does."""
    return f"CAST(round(CAST({expression} AS DECIMAL(18, 12)), 4) AS DOUBLE)"


def profile_sql(source, columns):
    """Profile of a table in SQL, column by column, with the typing rules restated."""
    rows = " UNION ALL ".join(_column_sql(source, c, k) for c, k in columns.items())
    return f"""(WITH m AS ({rows}), r AS (SELECT *, CASE WHEN nn > 0 THEN u / nn ELSE 0.0 END AS ratio FROM m), i AS (
      SELECT *, CASE kind
          WHEN 'numeric' THEN ratio >= 0.95 AND (id_name OR (NOT (money_name OR pct_name) AND whole AND ratio >= 0.99
                              AND u >= 20 AND step > 0.9))
          WHEN 'text' THEN strong_name AND u > 1 AND coalesce(dates, 0) < 0.8 ELSE false END AS is_identifier FROM r)
    SELECT c AS "column", kind, row_count, nn < row_count AS nullable, row_count - nn AS missing_count,
      (row_count - nn) / row_count AS missing_ratio, u AS unique_count, {half_up('ratio')} AS unique_ratio,
      mn AS min_value, mx AS max_value, mean, med AS median, std, {half_up('coalesce(neg, 0)')} AS negative_ratio,
      {half_up('coalesce(zero, 0)')} AS zero_ratio, t0 AS first_time, t1 AS last_time, is_identifier, u <= 1 AS is_constant,
      kind <> 'datetime' AND ratio >= 0.9 AND u > 50 AS is_high_cardinality,
      kind = 'numeric' AND NOT is_identifier AND u >= 3 AS is_forecast_candidate,
      CASE WHEN kind = 'datetime' THEN 'datetime'
           WHEN is_identifier THEN 'identifier'
           WHEN kind = 'numeric' THEN CASE WHEN bits AND u <= 2 THEN 'boolean' WHEN unit > 0.9 AND pct_name THEN 'percentage'
             WHEN money_name THEN 'monetary' WHEN whole THEN 'discrete_numeric' ELSE 'continuous_numeric' END
           WHEN dates >= 0.8 THEN 'datetime' WHEN words > 0.95 THEN 'boolean' WHEN geo_name THEN 'geographic'
           WHEN u <= 50 AND ratio <= 0.5 THEN 'categorical' ELSE 'free_text' END AS semantic_type,
      coalesce(dates, 0.0) AS date_parse_rate
    FROM i)"""


def of_table(name):
    return profile_sql(name, COLUMNS[name])


@query(
    "profile_shape",
    "SELECT count(*) AS row_count, CAST(5 AS BIGINT) AS column_count, CASE WHEN count(*) = 0 THEN 'dataset is empty' END AS warning FROM documents",
)
def profile_shape(spark, sf):
    return profile.profile_shape(table(spark, sf, "documents"))


NULLED_CUSTOMER = """(SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer)"""


@query(
    "profile_nulls",
    'SELECT "column", row_count, nullable, missing_count, round(missing_ratio, 6) AS missing_ratio FROM '
    + profile_sql(NULLED_CUSTOMER, {"c_custkey": "numeric", "c_name": "text", "c_acctbal": "numeric"}),
)
def profile_nulls(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name"),
        F.expr("CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal"),
    )
    return rounded(profile.profile_nulls(customers), 6, "missing_ratio")


@query("profile_distinct", f'SELECT "column", unique_count, unique_ratio FROM {of_table("lineitem")}')
def profile_distinct(spark, sf):
    return profile.profile_columns(table(spark, sf, "lineitem"), with_medians=False).select(
        "column", "unique_count", "unique_ratio"
    )


NUMBERS = {c: k for c, k in COLUMNS["lineitem"].items() if k == "numeric"}


@query(
    "profile_numeric",
    f"""SELECT "column", min_value, max_value, round(mean, 4) AS mean, median, round(std, 4) AS std, negative_ratio, zero_ratio,
          semantic_type FROM {profile_sql("lineitem", NUMBERS)}""",
)
def profile_numeric(spark, sf):
    lines = table(spark, sf, "lineitem").select(*NUMBERS)
    return rounded(profile.profile_columns(lines), 4, "mean", "std").select(
        "column", "min_value", "max_value", "mean", "median", "std", "negative_ratio", "zero_ratio", "semantic_type"
    )


TEXTS = {c: k for c, k in COLUMNS["documents"].items() if k == "text"}


@query(
    "profile_text",
    f'SELECT "column", semantic_type, unique_count, unique_ratio, is_constant, is_high_cardinality FROM {profile_sql("documents", TEXTS)}',
)
def profile_text(spark, sf):
    return profile.profile_columns(table(spark, sf, "documents").select(*TEXTS)).select(
        "column", "semantic_type", "unique_count", "unique_ratio", "is_constant", "is_high_cardinality"
    )


@query(
    "profile_datetime",
    f"""SELECT "column", first_time, last_time, unique_count, semantic_type FROM {profile_sql("events", {"ts": "datetime"})}
        UNION ALL
        SELECT "column", first_time, last_time, unique_count, semantic_type FROM {profile_sql("orders", {"o_orderdate": "datetime"})}""",
)
def profile_datetime(spark, sf):
    wanted = ["column", "first_time", "last_time", "unique_count", "semantic_type"]
    first = profile.profile_columns(table(spark, sf, "events").select("ts")).select(*wanted)
    return first.union(profile.profile_columns(table(spark, sf, "orders").select("o_orderdate")).select(*wanted))


@query(
    "profile_boolean",
    """SELECT 'is_good' AS "column", avg(CAST(quality = 1 AS INT)) AS mean, count(DISTINCT quality = 1) AS unique_count,
              'boolean' AS semantic_type FROM labels""",
)
def profile_boolean(spark, sf):
    labels = table(spark, sf, "labels").select((F.col("quality") == 1).alias("is_good"))
    return profile.profile_columns(labels).select("column", "mean", "unique_count", "semantic_type")


def _samples_sql(source, name):
    return f"""SELECT '{name}' AS "column", rank, sample FROM (
      SELECT row_number() OVER (ORDER BY long, key) AS rank, sample FROM (
        SELECT DISTINCT {name} AS sample, length({name}) > 256 AS long,
               CASE WHEN length({name}) > 256 THEN sha256({name}) ELSE {name} END AS key
        FROM {source} WHERE {name} IS NOT NULL)) WHERE rank <= 3"""


@query(
    "profile_samples",
    " UNION ALL ".join([_samples_sql("documents", c) for c in ("text", "lang", "source")])
    + """ UNION ALL SELECT 'doc_id' AS "column", rank, CAST(doc_id AS VARCHAR) AS sample FROM (
           SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM (SELECT DISTINCT doc_id FROM documents)) WHERE rank <= 3
         UNION ALL SELECT 'n_chars', rank, CAST(n_chars AS VARCHAR) FROM (
           SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS rank FROM (SELECT DISTINCT n_chars FROM documents)) WHERE rank <= 3""",
)
def profile_samples(spark, sf):
    return profile.profile_samples(table(spark, sf, "documents"))


@query(
    "detect_identifiers",
    f"""SELECT "column", is_identifier FROM {of_table("orders")} UNION ALL SELECT "column", is_identifier FROM {of_table("events")}""",
)
def detect_identifiers(spark, sf):
    found = [
        profile.profile_columns(table(spark, sf, t), with_medians=False).select("column", "is_identifier")
        for t in ("orders", "events")
    ]
    return found[0].union(found[1])


@query(
    "sequential_key_test",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", v AS "values", step AS step_share, v >= 20 AND step > 0.9 AS is_sequential FROM (
             SELECT count(*) AS v, avg(CAST(d = 1 AS INT)) FILTER (WHERE d IS NOT NULL) AS step FROM (
               SELECT x - lag(x) OVER (ORDER BY x) AS d FROM (SELECT DISTINCT {c} AS x FROM lineitem WHERE {c} % 1 = 0)))"""
        for c in NUMBERS
    ),
)
def sequential_key_test(spark, sf):
    return profile.sequential_key_test(table(spark, sf, "lineitem"))


ANSWERS = """(SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'Yes' ELSE 'no' END AS answer,
  CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'maybe' END AS doubt FROM labels)"""


@query(
    "detect_booleans",
    f"""SELECT "column", semantic_type = 'boolean' AS is_boolean FROM {profile_sql(ANSWERS, {
        "doc_id": "numeric", "quality": "numeric", "answer": "text", "doubt": "text"})}""",
)
def detect_booleans(spark, sf):
    labels = table(spark, sf, "labels").select(
        "doc_id", "quality", F.expr("CASE WHEN toxic = 1 THEN 'Yes' ELSE 'no' END AS answer"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'maybe' END AS doubt"),
    )
    return profile.profile_columns(labels, with_medians=False).select(
        "column", (F.col("semantic_type") == "boolean").alias("is_boolean")
    )


CLASSIFIED = ("part", "customer", "lineitem")


@query(
    "classify_semantic_type",
    " UNION ALL ".join(f"""SELECT '{t}' AS table_name, "column", semantic_type FROM {of_table(t)}""" for t in CLASSIFIED),
)
def classify_semantic_type(spark, sf):
    parts = [
        profile.profile_columns(table(spark, sf, t), with_medians=False)
        .select(F.lit(t).alias("table_name"), "column", "semantic_type")
        for t in CLASSIFIED
    ]
    return parts[0].union(parts[1]).union(parts[2])


FLAGGED = "(SELECT *, 1 AS version FROM part)"
FLAGGED_COLUMNS = {**COLUMNS["part"], "version": "numeric"}


@query("flag_constant", f'SELECT "column", is_constant FROM {profile_sql(FLAGGED, FLAGGED_COLUMNS)}')
def flag_constant(spark, sf):
    parts = table(spark, sf, "part").withColumn("version", F.lit(1))
    return profile.profile_columns(parts, with_medians=False).select("column", "is_constant")


@query("flag_high_cardinality", f'SELECT "column", is_high_cardinality FROM {of_table("customer")}')
def flag_high_cardinality(spark, sf):
    return profile.profile_columns(table(spark, sf, "customer"), with_medians=False).select(
        "column", "is_high_cardinality"
    )


DATED = """SELECT o_orderkey, o_orderdate, o_orderpriority,
  CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' WHEN o_orderkey % 10 = 1 THEN NULL
       ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS noted_day,
  CASE WHEN o_orderkey % 2 = 0 THEN 'M01' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS half_day FROM {source}"""
DATED_SQL = "(" + DATED.format(source="orders").replace("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')") + ")"


def dated_orders(spark, sf):
    return spark.sql(DATED.format(source="{orders}"), orders=table(spark, sf, "orders"))


@query(
    "date_parse_rate",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(rate, 6) AS date_parse_rate, rate >= 0.8 AS is_date_column FROM (
          SELECT avg(CAST(coalesce(year(TRY_CAST({c} AS TIMESTAMP)) BETWEEN 1900 AND 2100, false) AS INT))
                 FILTER (WHERE {c} IS NOT NULL) AS rate FROM {DATED_SQL})"""
        for c in ("noted_day", "half_day", "o_orderpriority")
    ),
)
def date_parse_rate(spark, sf):
    return rounded(profile.date_parse_rate(dated_orders(spark, sf)), 6, "date_parse_rate")


# Dates of several forms in one column, days first in one and months first in another.
FORMED = """SELECT CASE o_orderkey % 5 WHEN 0 THEN {day} WHEN 1 THEN {slash} WHEN 2 THEN {word} WHEN 3 THEN {long} ELSE NULL END AS mixed_day,
  CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE {month_first} END AS shipped, o_orderstatus FROM {source}"""


@query(
    "mixed_date_rate",
    """SELECT 'mixed_day' AS "column", 1.0 AS date_parse_rate, true AS is_date_column, min(d) AS first_date, max(d) AS last_date, count(*) AS texts,
          'cast, parts, day and word, word and day' AS forms, true AS day_first
        FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d FROM orders WHERE o_orderkey % 5 < 4)
        UNION ALL SELECT 'shipped', round(count(*) FILTER (WHERE o_orderkey % 7 <> 0) / count(*), 6), true,
          min(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) FILTER (WHERE o_orderkey % 7 <> 0), max(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) FILTER (WHERE o_orderkey % 7 <> 0),
          count(*), 'parts', false FROM orders
        UNION ALL SELECT 'o_orderstatus', 0.0, false, NULL, NULL, count(*), '', false FROM orders""",
)
def mixed_date_rate(spark, sf):
    form = lambda pattern: f"date_format(o_orderdate, '{pattern}')"
    sql = FORMED.format(day=form("yyyy-MM-dd"), slash=form("dd/MM/yyyy"), word=form("d MMM yyyy"), long=form("MMMM d, yyyy"), month_first=form("MM-dd-yyyy"), source="{orders}")
    return rounded(dates.mixed_date_rate(spark.sql(sql, orders=table(spark, sf, "orders"))), 6, "date_parse_rate")


def _date_score_sql(name, stamp, name_bonus):
    return f"""SELECT '{name}' AS "column", round(0.45 * rate + 0.2 * least(u / n * 2, 1) + 0.2 * least(span / 365, 1) + {name_bonus}, 4) AS score,
        round(rate, 4) AS parse_success_rate
      FROM (SELECT count({stamp}) / count({name}) AS rate, count(DISTINCT {stamp}) AS u, count({stamp}) AS n,
                   epoch(max({stamp}) - min({stamp})) / 86400 AS span FROM {DATED_SQL})"""


@query(
    "rank_date_columns",
    f"""SELECT row_number() OVER (ORDER BY score DESC, "column" DESC) AS rank, *,
          row_number() OVER (ORDER BY score DESC, "column" DESC) = 1 AND score >= 0.5 AS is_primary
        FROM ({_date_score_sql("o_orderdate", "o_orderdate", 0.15)} UNION ALL
              {_date_score_sql("noted_day", "TRY_CAST(noted_day AS TIMESTAMP)", 0.15)})""",
)
def rank_date_columns(spark, sf):
    return profile.rank_date_columns(profile.profile_columns(dated_orders(spark, sf), with_medians=False))


@query(
    "list_dimensions",
    f"""SELECT "column", semantic_type, unique_count FROM {of_table("lineitem")}
        WHERE semantic_type IN ('categorical', 'boolean', 'geographic') AND NOT is_identifier AND NOT is_constant""",
)
def list_dimensions(spark, sf):
    profiled = profile.profile_columns(table(spark, sf, "lineitem"), with_medians=False)
    return profile.list_dimensions(profiled).drop("position")


METRIC_FILTER = "semantic_type IN ('continuous_numeric', 'discrete_numeric', 'monetary', 'percentage') AND NOT is_identifier"


@query("list_metrics", f'SELECT "column", semantic_type, is_forecast_candidate FROM {of_table("lineitem")} WHERE {METRIC_FILTER}')
def list_metrics(spark, sf):
    profiled = profile.profile_columns(table(spark, sf, "lineitem"), with_medians=False)
    return profile.list_metrics(profiled).drop("position")


CATALOGUED = """(SELECT l_quantity AS quantity, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS revenue,
  l_discount AS discount_rate, l_linenumber AS line, l_tax * 1.5 - 0.03 AS tax_net FROM lineitem)"""
CATALOGUED_COLUMNS = dict.fromkeys(("quantity", "price", "revenue", "discount_rate", "line", "tax_net"), "numeric")


@query(
    "metric_catalogue",
    f"""SELECT metric_key, semantic_type, agg AS default_aggregation, allowed AS allowed_aggregations, non_negative,
          agg = 'sum' AS additive, forecastable, CAST(confidence AS DOUBLE) AS discovery_confidence, confidence < 0.6 AS needs_confirmation
        FROM (SELECT "column" AS metric_key, semantic_type, is_forecast_candidate AS forecastable,
          negative_ratio = 0 OR (NOT contains("column", 'net') AND negative_ratio <= 0.1) AS non_negative,
          CASE WHEN semantic_type = 'percentage' THEN 'mean' WHEN "column" = 'price' THEN 'mean'
               WHEN "column" = 'discount_rate' THEN 'mean'
               WHEN "column" IN ('revenue', 'quantity', 'line') THEN 'sum' WHEN zero_ratio < 0.05 THEN 'mean' ELSE 'sum' END AS agg,
          CASE WHEN semantic_type = 'percentage' THEN 'mean,min,max' WHEN "column" = 'price' THEN 'mean,min,max,median'
               WHEN "column" IN ('revenue', 'quantity', 'line') THEN 'sum,mean,min,max'
               WHEN zero_ratio < 0.05 THEN 'mean,sum,min,max' ELSE 'sum,mean,min,max' END AS allowed,
          CASE WHEN semantic_type = 'percentage' THEN 0.9 WHEN "column" = 'price' THEN 0.85 WHEN "column" = 'revenue' THEN 0.9
               WHEN "column" = 'quantity' THEN 0.85 WHEN "column" = 'line' THEN 0.55 ELSE 0.4 END AS confidence
          FROM {profile_sql(CATALOGUED, CATALOGUED_COLUMNS)} WHERE {METRIC_FILTER})""",
)
def metric_catalogue(spark, sf):
    lines = spark.sql("SELECT * FROM " + CATALOGUED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    found = catalogue.metric_catalogue(profile.profile_columns(lines, with_medians=False))
    return found.withColumn("allowed_aggregations", F.array_join("allowed_aggregations", ",")).drop("field")


@query(
    "identifier_count_metrics",
    f"""SELECT "column" || '_distinct_count' AS metric_key, "column" AS field, 'nunique' AS default_aggregation,
          CAST(0.6 AS DOUBLE) AS discovery_confidence FROM {of_table("customer")} WHERE is_identifier""",
)
def identifier_count_metrics(spark, sf):
    profiled = profile.profile_columns(table(spark, sf, "customer"), with_medians=False)
    return catalogue.identifier_count_metrics(profiled, has_date_column=False).select(
        "metric_key", "field", "default_aggregation", "discovery_confidence"
    )


@query(
    "time_range",
    """SELECT event_type, min(ts) AS start, max(ts) AS "end", CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS days
       FROM events GROUP BY 1""",
)
def time_range(spark, sf):
    return catalogue.time_range(table(spark, sf, "events"), "ts", ["event_type"])


SIGNED = "o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string,o_totalprice:double"
NUMBER_SIGNATURE = """'{c}:' || printf('%.3f:%.3f:%.3f:%.3f', avg({c}), stddev_pop({c}), CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE))"""


@query(
    "dataset_fingerprint",
    f"""SELECT substring(md5('{','.join(c.split(":")[0] for c in SIGNED.split(","))}|{SIGNED}|rows:' || count(*) || '|' ||
          {" || ',' || ".join(NUMBER_SIGNATURE.format(c=c) for c in ("o_custkey", "o_orderkey", "o_totalprice"))} || '|fe_v2'), 1, 16) AS fingerprint,
          count(*) AS row_count FROM orders""",
)
def dataset_fingerprint(spark, sf):
    return catalogue.dataset_fingerprint(table(spark, sf, "orders"))


STATED = """(SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS amount_text,
  o_orderdate, o_orderpriority FROM orders)"""


@query(
    "column_statistics",
    f"""SELECT 'o_orderkey' AS "column", count(o_orderkey) AS non_null_count, count(*) - count(o_orderkey) AS null_count,
          'numeric' AS type, sum(o_orderkey) + 0.0 AS sum, round(avg(o_orderkey), 4) AS mean, min(o_orderkey) + 0.0 AS minimum,
          max(o_orderkey) + 0.0 AS maximum, NULL AS first_date, NULL AS last_date, count(DISTINCT o_orderkey) AS unique_count FROM {STATED}
        UNION ALL
        SELECT 'amount_text', count(amount_text), count(*) - count(amount_text), 'numeric', sum(TRY_CAST(amount_text AS DOUBLE)),
          round(avg(TRY_CAST(amount_text AS DOUBLE)), 4), min(TRY_CAST(amount_text AS DOUBLE)), max(TRY_CAST(amount_text AS DOUBLE)),
          NULL, NULL, count(DISTINCT amount_text) FROM {STATED}
        UNION ALL
        SELECT 'o_orderdate', count(o_orderdate), count(*) - count(o_orderdate), 'datetime', NULL, NULL, NULL, NULL,
          min(o_orderdate), max(o_orderdate), count(DISTINCT o_orderdate) FROM {STATED}
        UNION ALL
        SELECT 'o_orderpriority', count(o_orderpriority), count(*) - count(o_orderpriority), 'categorical', NULL, NULL, NULL, NULL,
          NULL, NULL, count(DISTINCT o_orderpriority) FROM {STATED}""",
)
def column_statistics(spark, sf):
    orders = spark.sql(
        "SELECT * FROM " + STATED.replace("FROM orders", "FROM {orders}").replace("VARCHAR", "STRING"),
        orders=table(spark, sf, "orders"),
    )
    return rounded(catalogue.column_statistics(orders), 4, "mean")


def _top_sql(name):
    return f"""SELECT '{name}' AS "column", rank, value, n, u AS unique_count, u <= 10 AS is_complete FROM (
      SELECT CAST({name} AS VARCHAR) AS value, count(*) AS n, count(*) OVER () AS u,
             row_number() OVER (ORDER BY count(*) DESC, CAST({name} AS VARCHAR)) AS rank
      FROM lineitem GROUP BY {name}) WHERE rank <= 10"""


TOP_COLUMNS = tuple(COLUMNS["lineitem"])


@query("top_values", " UNION ALL ".join(_top_sql(c) for c in TOP_COLUMNS))
def top_values(spark, sf):
    return catalogue.top_values(table(spark, sf, "lineitem"))


PAIRS = list(combinations(NUMBERS, 2))


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS first_column, '{b}' AS second_column, round(corr({a}, {b}), 4) + 0 AS correlation,
              count(*) AS observations FROM lineitem"""
        for a, b in PAIRS
    ),
)
def correlation_matrix(spark, sf):
    return catalogue.correlation_matrix(table(spark, sf, "lineitem"))


DIMENSIONS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query(
    "dimension_values",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM part) AS unique_count, string_agg(v, '|' ORDER BY v) AS example_values
            FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM part ORDER BY 1 LIMIT 25)"""
        for c in DIMENSIONS
    ),
)
def dimension_values(spark, sf):
    found = catalogue.dimension_values(table(spark, sf, "part"), DIMENSIONS)
    return found.withColumn("example_values", F.array_join("example_values", "|"))


@query(
    "find_value_columns",
    """SELECT n_name AS term, "column", count(*) AS row_count FROM (
         SELECT 'c_mktsegment' AS "column", lower(trim(c_mktsegment)) AS v FROM customer
         UNION ALL SELECT 'c_name', lower(trim(c_name)) FROM customer) JOIN (
         SELECT DISTINCT '  ' || upper(event_type) || ' ' AS n_name FROM events
         UNION SELECT ' Building ' UNION SELECT c_name FROM customer) t ON lower(trim(n_name)) = v GROUP BY 1, 2""",
)
def find_value_columns(spark, sf):
    customers = table(spark, sf, "customer").select("c_name", "c_mktsegment")
    terms = (
        table(spark, sf, "events").select(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")).alias("term"))
        .union(customers.select(F.lit(" Building ").alias("term"))).union(customers.select("c_name"))
    )
    return catalogue.find_value_columns(customers, terms)
