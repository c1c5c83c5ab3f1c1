"""Word lists, thresholds and defaults that define the results.

They are part of what the operators compute, so they stand here as plain text in one place.
"""

# --- filters -------------------------------------------------------------------------------
FILTER_OPERATORS = (
    "equals", "not_equals", "in", "not_in", "contains",
    "greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal",
    "between", "date_from", "date_to",
)
TRUE_WORDS = ("true", "1", "yes", "valid")
FALSE_WORDS = ("false", "0", "no", "invalid")

MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# --- text to number ------------------------------------------------------------------------
MISSING_WORDS = ("n/a", "na", "null", "undefined", "-", "--")
CURRENCY_AND_SPACE_PATTERN = r"[₹$€£,%\s]"
NUMERIC_TEXT_SHARE = 0.95

# --- column profiling ----------------------------------------------------------------------
DATE_NAME_HINTS = ("date", "time", "timestamp", "created", "updated", "day", "month", "year", "period")
IDENTIFIER_NAME_HINTS = ("id", "uuid", "guid", "code", "number", "no", "key")
MONETARY_NAME_HINTS = (
    "revenue", "profit", "price", "cost", "expense", "spend", "amount",
    "value", "invoice", "fee", "salary", "income", "budget", "sales",
)
PERCENTAGE_NAME_HINTS = ("rate", "ratio", "pct", "percent", "percentage", "utilization", "margin")
GEOGRAPHIC_NAME_HINTS = ("city", "state", "country", "region", "zone", "zip", "postal", "geo", "location")
STRONG_IDENTIFIER_NAMES = ("id", "uuid", "guid", "key")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "0", "1")
BOOLEAN_WORD_SHARE = 0.95
UNIT_INTERVAL_SHARE = 0.9
MAX_CATEGORICAL_CARDINALITY = 50
CATEGORICAL_UNIQUE_RATIO = 0.5
HIGH_CARDINALITY_RATIO = 0.9
IDENTIFIER_UNIQUE_RATIO = 0.95
UNNAMED_IDENTIFIER_UNIQUE_RATIO = 0.99
SEQUENTIAL_MIN_VALUES = 20
SEQUENTIAL_STEP_SHARE = 0.9
MIN_FORECAST_DISTINCT = 3

# --- date columns --------------------------------------------------------------------------
DATE_PARSE_FLOOR = 0.8
DATE_MIN_SCORE = 0.5
DATE_FIRST_YEAR = 1900
DATE_LAST_YEAR = 2100
DATE_SCORE_WEIGHTS = {"parse": 0.45, "unique": 0.2, "span": 0.2, "name": 0.15}

# --- metric catalogue ----------------------------------------------------------------------
SUM_NAME_HINTS = (
    "revenue", "sales", "quantity", "units", "cost", "spend", "usage",
    "minutes", "points", "amount", "transactions", "downtime", "energy",
)
MEAN_NAME_HINTS = (
    "temperature", "rating", "score", "percentage", "pct", "rate",
    "conversion", "utilization", "latency", "price", "average", "aov", "margin",
)
SIGNED_NAME_HINTS = (
    "profit", "margin", "change", "delta", "temperature", "balance",
    "variance", "deviation", "net", "growth", "return",
)
ERROR_NEGATIVE_RATIO = 0.1
MEAN_LIKE_ZERO_RATIO = 0.05
CONFIRM_BELOW_CONFIDENCE = 0.6

# --- dataset statistics --------------------------------------------------------------------
STATISTICS_DATE_WORDS = ("date", "time", "timestamp")
TOP_VALUES_LIMIT = 10
DIMENSION_EXAMPLES = 25

# --- correlation labels --------------------------------------------------------------------
STRONG_CORRELATION = 0.7
MODERATE_CORRELATION = 0.3

# --- forecasting ---------------------------------------------------------------------------
GRANULARITIES = ("day", "week", "month")
MIN_PERIODS = {"day": 14, "week": 8, "month": 6}
MAX_HORIZON = {"day": 90, "week": 26, "month": 24}
DEFAULT_HORIZON = {"day": 7, "week": 4, "month": 3}
HISTORY_WINDOW = {"day": 30, "week": 20, "month": 12}
MAX_MISSING_RATIO = 0.4
MAX_ZERO_RATIO = 0.7
MIN_SERIES_DISTINCT = 3
FORECASTABILITY_WEIGHTS = {"density": 0.4, "completeness": 0.35, "variability": 0.25}
FEATURE_COLUMNS = (
    "t", "lag_1", "lag_2", "lag_3",
    "rolling_mean_3", "rolling_mean_7", "rolling_std_3",
    "pct_growth", "prev_growth", "cumulative_trend",
    "month", "quarter", "weekday", "week_of_year", "year",
)
FEATURE_VERSION = 2
MIN_FEATURE_ROWS = 5
INTERVAL_Z = 1.2816
RIDGE_ALPHA = 1.0
BOOSTED_MIN_ROWS = 40
BOOSTED_DEPTH = 4
BOOSTING_ROUNDS = 100
BOOSTING_RATE = 0.1
BOOSTING_LEAF_ROWS = 20
BOOSTING_BINS = 255
MIN_IMPROVEMENT = 0.03
RETRAIN_ROW_GROWTH = 0.01
RETRAIN_NEW_ROWS = 500
RETRAIN_MAX_AGE_DAYS = 14
CHALLENGER_R2_DROP = 0.15

# --- series insights -----------------------------------------------------------------------
DIRECTION_PERCENT = 3
HIGH_VOLATILITY = 0.5
MODERATE_VOLATILITY = 0.2
SEASONAL_MIN_PERIODS = 8
SEASONAL_MAX_LAG = 12
SEASONAL_STRENGTH = 0.4
ANOMALY_Z = 2.5
ANOMALY_MIN_PERIODS = 4
WIDENING_FACTOR = 1.05

# Keyword rules in order; the first rule with a matching keyword decides. Each row is
# (keywords, category when rising, category when falling).
RECOMMENDATION_RULES = (
    (("revenue", "sales", "income", "turnover"), "cash_flow_preparation", "budget_review"),
    (("cost", "expense", "spend", "budget"), "cost_control", "no_action"),
    (("downtime", "outage", "failure"), "preventive_maintenance", "no_action"),
    (("energy", "electricity", "power", "usage", "consumption"), "demand_planning", "no_action"),
    (("churn", "cancellation", "attrition"), "customer_retention", "no_action"),
    (("inventory", "stock", "units_sold", "quantity", "sold"), "inventory_planning", "inventory_planning"),
    (("headcount", "staff", "tickets", "orders", "transactions", "volume"), "staffing", "staffing"),
)
NO_CONTEXT_HINTS = ("temperature", "rating", "score", "latency")
HIGH_PRIORITY_CHANGE_PERCENT = 10

# --- text ----------------------------------------------------------------------------------
SEGMENT_BOUNDARY_PATTERN = r"[;\n]+"
LIST_PREFIX_PATTERN = r"^(?:[-*•]\s*|\d+[\.\)]\s*|[a-zA-Z][\.\)]\s*)"
MATCH_STOP_WORDS = (
    "the", "a", "an", "of", "for", "in", "on", "to", "and", "next",
    "please", "show", "me", "what", "was", "is", "our", "give",
)
MATCH_MIN_SCORE = 0.2
MATCH_NEAR_TIE = 0.8
KEPT_TURNS = 6
CONTEXT_TURNS = 4
SCATTER_POINTS = 1000
SCATTER_SEED = 42

# Candidate models in order of preference; the earlier one wins equal scores.
NAIVE, SEASONAL, LINEAR, RIDGE, BOOSTED = (
    "naive_last_value", "seasonal_naive", "linear_regression", "ridge", "boosted_trees",
)
MODELS = (NAIVE, SEASONAL, LINEAR, RIDGE, BOOSTED)

# Cells that mean "missing" in a delimited file.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
PROFILER_VERSION = 2
CATALOGUE_VERSION = 3
