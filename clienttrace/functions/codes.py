"""Merchant-code range tables and their lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ranges = Sequence[tuple[int, int, str]]

# Half-open code ranges [low, high) and their names.
CANONICAL: Ranges = (
    (1, 1500, "Agriculture"),
    (1500, 3000, "Construction"),
    (3000, 3300, "Airlines"),
    (3300, 3500, "Car Rental"),
    (3500, 4000, "Hotels"),
    (4000, 4800, "Transportation"),
    (4800, 5000, "Utilities and Telecom"),
    (5000, 5600, "Retail Stores"),
    (5600, 5700, "Clothing Stores"),
    (5700, 5800, "Home Furnishing"),
    (5800, 5900, "Restaurants and Food"),
    (5900, 6000, "Pharmacies"),
    (6000, 7000, "Financial Services"),
    (7000, 7300, "Personal Services"),
    (7300, 7500, "Business Services"),
    (7500, 7600, "Auto Services"),
    (7600, 7700, "Repair Services"),
    (7700, 7800, "Entertainment"),
    (7800, 8000, "Recreation"),
    (8000, 8100, "Medical Services"),
    (8100, 8200, "Legal Services"),
    (8200, 8300, "Education"),
)
FULL: Ranges = (
    (1, 1500, "Agriculture"),
    (1500, 3000, "Construction/Contractors"),
    (3000, 3300, "Airlines"),
    (3300, 3500, "Car Rental"),
    (3500, 4000, "Hotels/Lodging"),
    (4000, 4800, "Transportation"),
    (4800, 5000, "Utilities/Telecom"),
    (5000, 5600, "Retail/Stores"),
    (5600, 5700, "Clothing"),
    (5700, 5800, "Home Furnishing"),
    (5800, 5900, "Restaurants/Food"),
    (5900, 6000, "Drug Stores/Pharmacies"),
    (6000, 7000, "Financial Services"),
    (7000, 7300, "Personal Services"),
    (7300, 7500, "Business Services"),
    (7500, 7600, "Auto Services"),
    (7600, 7700, "Repair Services"),
    (7700, 7800, "Entertainment"),
    (7800, 8000, "Recreation"),
    (8000, 8100, "Medical Services"),
    (8100, 8200, "Legal Services"),
    (8200, 8300, "Education"),
    (8300, 8700, "Membership/Organizations"),
    (8700, 8800, "Professional Services"),
    (8800, 9000, "Government"),
    (9000, 10000, "Government/Other"),
)
SHORT: Ranges = (
    (1, 1500, "Agriculture"),
    (4000, 4800, "Transportation"),
    (5000, 5600, "Retail"),
    (5600, 5700, "Clothing"),
    (5800, 5900, "Restaurants"),
    (6000, 7000, "Financial"),
    (7500, 7600, "Auto"),
    (8000, 8100, "Medical"),
    (8200, 8300, "Education"),
)
CHURN: Ranges = (
    (1, 1500, "Agriculture"),
    (4000, 4800, "Transportation"),
    (4800, 5000, "Utilities"),
    (5000, 5600, "Retail"),
    (5600, 5700, "Clothing"),
    (5800, 5900, "Restaurants"),
    (6000, 7000, "Financial Services"),
    (7500, 7600, "Auto Services"),
    (7700, 7800, "Entertainment"),
    (8000, 8100, "Medical"),
)
DEFAULT = "Other"
NOT_A_NUMBER = "Unknown"

# The table without the legal and education ranges.
CORE: Ranges = tuple(r for r in CANONICAL if r[0] < 8100)
# Some evidence scripts name the range 7500-7599 differently.
SHORT_AUTO_SERVICES: Ranges = tuple((a, b, "Auto Services" if n == "Auto" else n) for a, b, n in SHORT)

TABLES = {
    "canonical": CANONICAL,
    "core": CORE,
    "full": FULL,
    "short": SHORT,
    "short_auto_services": SHORT_AUTO_SERVICES,
    "churn": CHURN,
}


def classify_code(code: Column, ranges: Ranges = CANONICAL, default: str = DEFAULT,
                  not_a_number: str | None = None) -> Column:
    """Name of the range a code falls in, as one generated ``CASE``.

    A value that is no integer gets ``not_a_number`` (the default name unless
    given). The tables have at most 26 ranges, so a ``CASE`` inside code
    generation beats a join.
    """
    number = code.try_cast("int")
    branches = F.when(number.isNull(), F.lit(not_a_number or default))
    for low, high, name in ranges:
        branches = branches.when((number >= low) & (number < high), F.lit(name))
    return branches.otherwise(F.lit(default))


def range_lookup(df: DataFrame, code: str, ranges: DataFrame, out: str, default: str = DEFAULT,
                 width: int = 100) -> DataFrame:
    """The same lookup against a range table ``(low, high, name)`` of any size.

    Every range is spread over the buckets of ``width`` codes it covers, so the
    theta join becomes an equi join on the bucket plus a residual range test
    and neither side has to fit in memory. Ranges must not overlap.
    """
    spread = ranges.select(
        "low", "high", "name",
        F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("_bucket"))
    number = F.col(code).try_cast("int")
    left = df.withColumn("_number", number).withColumn("_bucket", F.floor(number / width))
    hit = ((left["_bucket"] == spread["_bucket"]) & (left["_number"] >= spread["low"])
           & (left["_number"] < spread["high"]))
    return (left.join(spread, hit, "left")
            .withColumn(out, F.coalesce(F.col("name"), F.lit(default)))
            .drop("_number", "_bucket", "low", "high", "name"))
