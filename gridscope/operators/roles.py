"""Business roles of columns: guessed from names, verified on values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridscope.functions.clean import kind_of, plain_number, quoted
from gridscope.functions.dates import date_of
from gridscope.operators.profile import batches

THRESHOLD = 0.8
# Name patterns per role; the first hit in this order decides.
ROLE_PATTERNS = [
    ("date", r"date|^dt$"),
    ("customer_name", r"cust(omer)?.?name|client.?name|^customer$|^client$"),
    ("product_name", r"product|item|sku|description"),
    ("quantity", r"qty|quantity|units?.?sold|^count$"),
    ("unit_price", r"unit.?price|price.?per|^price$|^rate$"),
    ("sales_amount", r"total|amount|revenue|sales"),
    ("expense_amount", r"expense|cost|spend"),
    ("category", r"category|type|segment|department"),
    ("notes", r"note|comment|remark"),
]
#: What the values of a role must be; roles that are not listed are taken by name alone.
EXPECTED = {
    "date": "dates",
    **dict.fromkeys(("sales_amount", "expense_amount", "unit_price", "quantity"), "numbers"),
    **dict.fromkeys(("customer_name", "product_name", "category"), "words"),
}

ROLE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("verified", T.BooleanType()),
    T.StructField("note", T.StringType()),
])


def role_of(name: str) -> str | None:
    """Role suggested by a column name, or None."""
    plain = name.strip().lower().replace(" ", "_")
    return next((role for role, pattern in ROLE_PATTERNS if re.search(pattern, plain)), None)


def split_columns(columns: Iterable[str]) -> tuple[dict[str, str], list[str]]:
    """``(role per recognised column, unrecognised columns)``."""
    matched = {c: role_of(c) for c in columns}
    return {c: r for c, r in matched.items() if r}, [c for c, r in matched.items() if not r]


def _hits(df: DataFrame, column: str, expected: str) -> dict[str, Column]:
    """What is counted of a column: cells that are what its role expects, and numbers not below zero."""
    dtype, cell = df.schema[column].dataType, F.col(quoted(column))
    if expected == "dates":
        return {"good": date_of(column, dtype).isNotNull()}
    number = cell.cast("double") if kind_of(dtype) == "number" else plain_number(cell.cast("string"))
    if expected == "words":
        return {"good": number.isNull() & cell.isNotNull()}
    return {"good": number.isNotNull(), "usable": number >= 0}


def verify_roles(df: DataFrame, roles: Mapping[str, str], confidence: str = "high") -> list[dict]:
    """Check guessed roles against the values, a batch of columns in one aggregate.

    At least 80 % of the non-null cells must be what :data:`EXPECTED` says, and of the numbers
    among them 80 % must not be negative.
    """
    known = [c for c in roles if c in df.columns]
    counted: dict[str, dict[str, int]] = {}
    for batch in batches(c for c in known if roles[c] in EXPECTED):
        facts = [("filled", c, F.col(quoted(c)).isNotNull()) for c in batch]
        facts += [(what, c, test) for c in batch for what, test in _hits(df, c, EXPECTED[roles[c]]).items()]
        flags = df.select(*[test.alias(f"t{i}") for i, (_, _, test) in enumerate(facts)])
        for (what, c, _), n in zip(facts, flags.agg(*[F.count_if(f"t{i}") for i in range(len(facts))]).first(), strict=True):
            counted.setdefault(c, {})[what] = n

    def judged(column: str) -> tuple[bool, str]:
        if column not in counted:
            return True, "taken by name"
        n = counted[column]
        note = f"{EXPECTED[roles[column]]}: {n['good']} of {n['filled']}"
        enough = n["good"] > 0 and n["good"] >= THRESHOLD * n["filled"]
        if "usable" not in n:
            return enough, note
        return enough and n["usable"] >= THRESHOLD * n["good"], f"{note}; not below zero: {n['usable']}"

    return [
        dict(zip(ROLE_SCHEMA.names, (i, c, roles[c], confidence, *judged(c)), strict=True)) for i, c in enumerate(known)
    ]


def roles_frame(df: DataFrame, verified: list[dict]) -> DataFrame:
    """The verification result as a DataFrame, one row per column."""
    return df.sparkSession.createDataFrame([tuple(r[f.name] for f in ROLE_SCHEMA.fields) for r in verified], ROLE_SCHEMA)
