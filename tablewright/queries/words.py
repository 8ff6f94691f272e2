"""The words that the SQL of the queries expects, written out so that a wrong word in an operator is seen."""

ID_WORDS = (
    "id key code sku uuid guid ssn ein zip postal phone isbn account_no order_id customer_id user_id "
    "employee_id item_id product_id trans_id transaction_id"
)
TYPE_ID_WORDS = ID_WORDS + " zipcode postal_code cust_id"
DATE_WORDS = "date time timestamp datetime year month day dob created_at updated_at period quarter"
NON_NEGATIVE_WORDS = (
    "age count quantity qty volume size days hours minutes seconds inventory stock years months"
)
PERCENT_WORDS = "pct percent percentage rate discount_pct share ratio"
METRIC_WORDS = (
    "sales revenue profit price cost amount mrr arr income expense total fee balance spend value rating "
    "score salary budget margin discount quantity volume count metric target"
)
CATEGORY_WORDS = (
    "category sub_category status region segment tier plan type group channel country state city "
    "department division gender role industry level stage"
)
TARGET_PARTS = (
    "revenue", "sales", "profit", "price", "amount", "target", "churn", "label", "income", "cost", "salary", "spend",
)
FINANCIAL_PARTS = "salary income revenue price amount cost spend".split()

GREETINGS = [
    "hi", "hii", "hiii", "hello", "hey", "heyy", "namaste", "hola", "greetings", "good morning", "good afternoon", "good evening",
]
PHRASES: dict[str, list[str]] = {
    "help": ["help", "what can you do", "who are you", "how to use", "what are you"],
    "schema": [
        "what are the column", "list column", "show column", "column name", "column list",
        "schema", "features", "data type", "dtypes",
    ],
    "shape": [
        "how many row", "row count", "how many col", "shape", "size", "dimension", "rows and column", "total record",
    ],
    "quality": ["quality", "health", "score", "how clean", "cleanliness", "audit"],
    "missing": ["missing", "null", "nan", "blank", "empty"],
    "duplicates": ["duplicate", "duplicate row", "repeats", "redundant", "dedup"],
    "grouped": [" by ", " across ", " per ", " grouped by "],
    "extreme": [
        "highest", "maximum", "max ", "max of", "top ", "most expensive", "cheapest", "lowest", "minimum",
        "min ", "min of", "best", "worst", "oldest", "youngest",
    ],
    "column_stats": ["average", "mean", "median", "describe", "summary", "stats", "distribution", "variance", "std"],
    "correlation": ["correlation", "correlated", "relationship", "relation", "driver", "factors"],
    "outliers": ["outlier", "anomaly", "anomalies", "extreme", "abnormal"],
    "preview": ["sample", "preview", "first 5", "first 10", "head", "show data", "table"],
}
