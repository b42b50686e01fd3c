"""Table schemas, change-table schemas and value domains."""

from __future__ import annotations

from pyspark.sql import types as T

PROVIDERS = T.StructType([
    T.StructField("Provider_ID", T.LongType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Type", T.StringType()),
    T.StructField("Address", T.StringType()),
    T.StructField("City", T.StringType()),
    T.StructField("Contact", T.StringType()),
])

RECEIVERS = T.StructType([
    T.StructField("Receiver_ID", T.LongType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Type", T.StringType()),
    T.StructField("City", T.StringType()),
    T.StructField("Contact", T.StringType()),
])

FOOD_LISTINGS = T.StructType([
    T.StructField("Food_ID", T.LongType()),
    T.StructField("Food_Name", T.StringType()),
    T.StructField("Quantity", T.LongType()),
    T.StructField("Expiry_Date", T.DateType()),
    T.StructField("Provider_ID", T.LongType()),
    T.StructField("Provider_Type", T.StringType()),
    T.StructField("Location", T.StringType()),
    T.StructField("Food_Type", T.StringType()),
    T.StructField("Meal_Type", T.StringType()),
])

CLAIMS = T.StructType([
    T.StructField("Claim_ID", T.LongType()),
    T.StructField("Food_ID", T.LongType()),
    T.StructField("Receiver_ID", T.LongType()),
    T.StructField("Status", T.StringType()),
    T.StructField("Timestamp", T.TimestampNTZType()),
])

SCHEMAS = {
    "providers": PROVIDERS,
    "receivers": RECEIVERS,
    "food_listings": FOOD_LISTINGS,
    "claims": CLAIMS,
}

KEYS = {
    "providers": "Provider_ID",
    "receivers": "Receiver_ID",
    "food_listings": "Food_ID",
    "claims": "Claim_ID",
}

# Foreign keys: (child table, column, parent table).
REFERENCES = [
    ("food_listings", "Provider_ID", "providers"),
    ("claims", "Food_ID", "food_listings"),
    ("claims", "Receiver_ID", "receivers"),
]


def change_schema(table: str) -> T.StructType:
    """Schema of a change table: op, seq, the table's columns, set_columns."""
    return T.StructType(
        [T.StructField("op", T.StringType()), T.StructField("seq", T.LongType())]
        + list(SCHEMAS[table].fields)
        + [T.StructField("set_columns", T.ArrayType(T.StringType()))])


# The choices offered by the reference's entry forms.
PROVIDER_TYPES = ("Restaurant", "Household", "Business", "Other")
RECEIVER_TYPES = ("NGO", "Individual", "Community", "Other")
FOOD_TYPES = ("Veg", "Non-Veg")
MEAL_TYPES = ("Breakfast", "Lunch", "Dinner", "Snack", "Other")
CLAIM_STATUSES = ("Pending", "Completed", "Cancelled")
# Lowest quantity a listing form accepts (one form allows 0, the other 1).
MIN_QUANTITY = 0

PENDING, COMPLETED, CANCELLED = CLAIM_STATUSES
