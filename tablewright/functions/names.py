"""Rules that look at column names only. They run while the plan is built."""

from __future__ import annotations

import re


def _suffix_rule(words: str) -> re.Pattern[str]:
    """Name equals one of the words, or ends in ``_word``."""
    return re.compile(rf"(?:^|_)(?:{'|'.join(words.split())})$", re.IGNORECASE)


# The words that give a column name its meaning.
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
SUM_PARTS = "sales revenue profit amount volume mrr arr spend cost total quantity".split()

_ID = _suffix_rule(ID_WORDS)
_TYPE_ID = _suffix_rule(TYPE_ID_WORDS)
_DATE = _suffix_rule(DATE_WORDS)
_NON_NEGATIVE = _suffix_rule(NON_NEGATIVE_WORDS)
_PERCENT = _suffix_rule(PERCENT_WORDS)
_METRIC = _suffix_rule(METRIC_WORDS)
_CATEGORY = _suffix_rule(CATEGORY_WORDS)


def is_id(name: str) -> bool:
    return bool(_ID.search(name))


def is_id_for_typing(name: str) -> bool:
    return bool(_TYPE_ID.search(name))


def is_date_named(name: str) -> bool:
    return bool(_DATE.search(name))


def is_non_negative(name: str) -> bool:
    return bool(_NON_NEGATIVE.search(name)) and not is_id(name)


def is_percentage(name: str) -> bool:
    low = name.lower()
    return bool(_PERCENT.search(name)) and "diff" not in low and "growth" not in low


def is_metric(name: str) -> bool:
    return bool(_METRIC.search(name))


def is_category(name: str) -> bool:
    return bool(_CATEGORY.search(name))


def has_part(name: str, parts: list[str]) -> bool:
    low = name.lower()
    return any(p in low for p in parts)


def is_target(name: str) -> bool:
    return has_part(name, TARGET_PARTS)


def is_financial(name: str) -> bool:
    return has_part(name, FINANCIAL_PARTS)


def is_summable(name: str) -> bool:
    return has_part(name, SUM_PARTS)
