"""They have to be exactly these for results to come out right."""

# --- meter tables ---------------------------------------------------------------------------
SEGMENTS = ("residential", "commercial")
METER_TYPES = ("smart", "standard")
RESIDENTIAL_SHARE = 0.7
SMART_SHARE = 0.8
JOIN_DATE_SPAN_DAYS = 5 * 365
CURRENCY = "GBP"

# tariff_id, segment, peak rate, off-peak rate, standing charge a day, peak hours
TARIFFS = (
    (1, "residential", 0.35, 0.22, 0.45, "06:00-09:00,18:00-22:00"),
    (2, "commercial", 0.28, 0.18, 1.20, "09:00-17:00"),
)

# --- synthetic load, kWh for one interval ---------------------------------------------------
RESIDENTIAL_MORNING = (6, 9, 0.8)
RESIDENTIAL_EVENING = (18, 22, 1.0)
RESIDENTIAL_BASE = 0.3
COMMERCIAL_WORKDAY = (9, 17, 2.5)
COMMERCIAL_BASE = 0.8
WINTER_MONTHS, WINTER_FACTOR = (12, 1, 2), 1.3
SUMMER_MONTHS, SUMMER_FACTOR = (6, 7, 8), 1.2
MILD_FACTOR = 0.85
NOISE_SHARE = 0.15
DEFAULT_SEED = 42
DEFAULT_INTERVAL_MINUTES = 15

# --- tools ----------------------------------------------------------------------------------
DEFAULT_ROW_LIMIT = 100
AGGREGATIONS = ("sum", "mean", "median", "count", "max", "min")
PLOT_TYPES = ("line", "bar", "scatter")

# tool, parameter, type, required, default
TOOL_PARAMETERS = (
    ("sql_executor", "query", "str", True, None),
    ("sql_executor", "row_limit", "int", False, "100"),
    ("pandas_aggregator", "query", "str", True, None),
    ("pandas_aggregator", "operation", "str", True, None),
    ("pandas_aggregator", "column", "str", True, None),
    ("pandas_aggregator", "group_by", "str", False, None),
    ("tariff_calculator", "customer_id", "int", True, None),
    ("tariff_calculator", "start_date", "str", True, None),
    ("tariff_calculator", "end_date", "str", True, None),
    ("plot_generator", "query", "str", True, None),
    ("plot_generator", "plot_type", "str", True, None),
    ("plot_generator", "x_column", "str", True, None),
    ("plot_generator", "y_column", "str", True, None),
    ("plot_generator", "title", "str", False, ""),
    ("calculate_load_factor", "customer_id", "int", True, None),
    ("calculate_load_factor", "start_date", "str", True, None),
    ("calculate_load_factor", "end_date", "str", True, None),
)
TRUE_WORDS = ("true", "1", "yes")

# --- transcripts ----------------------------------------------------------------------------
THOUGHT, ACTION, ACTION_INPUT, ANSWER = "Thought:", "Action:", "Action Input:", "Answer:"
# a section ends at the first of these that occurs in it, tried in this order
STOP_MARKERS = ("Thought:", "Action Input:", "Action:", "Answer:", "Observation:")
# a turn may end in one of these; the first that fits is dropped
OBSERVATION_SUFFIXES = ("Observation:", "\nObservation")
# the characters Python counts as white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ERROR_TEXTS = {
    "invalid_json": "the action input is not valid JSON",
    "missing_action_input": "an action without its input",
    "no_markers": "none of the section markers found",
}
NUMBER_PATTERN = r"[-+]?\d*\.\d+|\d+"

# --- episodes and scores --------------------------------------------------------------------
MAX_STEPS = 10
REWARD_TOOL_USED, REWARD_NO_TOOL = 2.0, -5.0
REWARD_SUCCESS, REWARD_FAILURE = 3.0, -3.0
REWARD_ACCURATE = 5.0
EXACT_EPSILON = 1e-6
DEFAULT_TOLERANCE_TYPE, DEFAULT_TOLERANCE = "relative", 0.05
EPOCHS, BATCH_SIZE = 3, 4

# --- workload -------------------------------------------------------------------------------
ANSWER_DECIMALS = 4
CATEGORIES = ("aggregation", "billing", "load_factor", "count", "plot")

# question texts; {id}, {segment}, {month}, {start} and {middle} are filled in
CUSTOMER_QUESTIONS = {
    "sum": "What is the total consumption for customer {id}?",
    "mean": "What is the average consumption for customer {id}?",
    "month_sum": "What is the total consumption for customer {id} in {month}?",
    "month_mean": "What is the average consumption for customer {id} in {month}?",
    "bill": "Calculate the electricity bill for customer {id} in {month}",
    "load_factor": "What is the load factor for customer {id} in {month}?",
    "count_readings": "How many readings are there for customer {id}?",
    "plot": "Plot the daily consumption for customer {id} in {month}",
    "half_load_factor": "What is the load factor for customer {id} between {start} and {middle}?",
    "trend_plot": "Visualize the consumption trend for customer {id} in {month}",
}
HALF_MONTH_DAYS = 15
SEGMENT_QUESTIONS = {
    "mean": "What is the average consumption for {segment} customers?",
    "sum": "What is the total consumption for {segment} customers?",
    "max": "What is the maximum consumption for {segment} customers?",
    "min": "What is the minimum consumption for {segment} customers?",
    "month_mean": "What is the average consumption for {segment} customers in {month}?",
    "count_customers": "How many {segment} customers are there?",
}
GENERAL_QUESTIONS = {
    "max": "What is the maximum consumption recorded for any customer?",
    "min": "What is the minimum consumption recorded?",
    "month_mean": "What is the average consumption for all customers in {month}?",
    "month_sum": "What is the total consumption in {month}?",
    "count_customers": "How many customers are in the database?",
    "count_readings": "How many readings are in the database?",
}
PLOT_QUESTIONS = (
    "Generate a bar chart of total consumption by customer segment",
    "Create a scatter plot of peak vs off-peak usage for all customers",
    "Show a bar chart of average consumption by meter type",
)
MINIMUM_QUESTION = "minimum consumption"
