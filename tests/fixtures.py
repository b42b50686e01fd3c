"""Hand-made edge rows in the true schema (FIXTURES.md section 3).

Namesakes, NULL cities, one-sided cities, a receiver / provider / listing
without claims or listings, a listing with only Pending claims, expiry dates
around ``as_of``, a NULL Food_Type, ties at every LIMIT, contacts with and
without '@', search text with regex characters, an orphan claim, a duplicate
claim id, a status outside the domain, Quantity 0 and a NULL Claim_ID.
"""

from __future__ import annotations

import datetime as D

from gleaner.schema import CLAIMS, FOOD_LISTINGS, PROVIDERS, RECEIVERS
from gleaner.tables import Tables

AS_OF = D.date(2025, 3, 17)
PARAMS = {
    "as_of": AS_OF.isoformat(),
    "city": "Delhi",
    "food_type": "Non-Veg",
    "listing_pattern": "rice|mum",
    "contact_pattern": "ravi|^asha$|a.b",
    "provider_name": "Asha",
}


def d(days: int) -> D.date:
    return AS_OF + D.timedelta(days=days)


def ts(day: int, hour: int = 10) -> D.datetime:
    return D.datetime(2025, 3, day, hour, 0, 0)


PROVIDER_ROWS = [
    (1, "Asha", "Restaurant", "12 Main St", "Delhi", "asha@example.org"),
    (2, "Asha", "Household", "3 Lake Rd", "Mumbai", "98765 43210"),
    (3, "Bina", "Business", None, None, None),                    # NULL city
    (4, "Chand", "Other", "9 Hill Rd", "Pune", "chand@mail.in"),  # provider-only city, no listings
    (5, "Dev (a.b)*", "Restaurant", "1 Fort", "Delhi", "dev@food.in"),  # regex characters
]

RECEIVER_ROWS = [
    (1, "Ravi", "NGO", "Delhi", "ravi@ngo.org"),
    (2, "Ravi", "Individual", "Mumbai", None),      # namesake
    (3, "Sita", "Community", None, "12345"),        # NULL city
    (4, "Tara", "Other", "Chennai", "tara@x.org"),  # receiver-only city, no claims
]

LISTING_ROWS = [
    (10, "Rice", 5, d(-1), 1, "Restaurant", "Delhi", "Veg", "Lunch"),
    (11, "Rice", 7, d(0), 2, "Household", "Mumbai", "Non-Veg", "Dinner"),
    (12, "Bread", 0, d(3), 1, "Restaurant", "Delhi", "Veg", "Breakfast"),
    (13, "Soup", 4, d(4), 3, "Business", None, None, "Snack"),        # NULL Food_Type, NULL location
    (14, "Dal", 3, None, 5, "Restaurant", "Delhi", "Non-Veg", "Lunch"),  # NULL expiry
    (15, "Curry", 6, d(8), 2, "Household", "Mumbai", "Non-Veg", "Lunch"),  # only Pending claims
    (16, "Apple", 2, d(1), 5, "Restaurant", "Delhi", "Veg", "Snack"),
    (17, "Zucchini", 2, d(2), 5, "Restaurant", "Delhi", "Veg", "Dinner"),  # never claimed
]

CLAIM_ROWS = [
    (100, 10, 1, "Completed", ts(10)),
    (101, 10, 2, "Completed", ts(11)),
    (102, 11, 1, "Pending", ts(12, 9)),
    (103, 11, 3, "Cancelled", ts(12, 18)),
    (104, 12, 1, "Completed", ts(14, 8)),
    (105, 15, 2, "Pending", ts(13)),
    (106, 13, 3, "Completed", None),       # NULL timestamp
    (107, 99, 1, "Completed", ts(15)),     # orphan: listing 99 does not exist
    (100, 16, 2, "Done", ts(16)),          # duplicate Claim_ID, status outside the domain
    (None, 14, 1, "Pending", ts(16, 12)),  # NULL Claim_ID
    (108, 16, 1, "Cancelled", ts(16, 13)),
]


def edge_tables(spark) -> Tables:
    return Tables(spark.createDataFrame(PROVIDER_ROWS, PROVIDERS),
                  spark.createDataFrame(RECEIVER_ROWS, RECEIVERS),
                  spark.createDataFrame(LISTING_ROWS, FOOD_LISTINGS),
                  spark.createDataFrame(CLAIM_ROWS, CLAIMS))


def empty_tables(spark) -> Tables:
    return Tables(spark.createDataFrame([], PROVIDERS), spark.createDataFrame([], RECEIVERS),
                  spark.createDataFrame([], FOOD_LISTINGS), spark.createDataFrame([], CLAIMS))
