"""Surplus-food donation analytics on Spark.

Four tables (providers, receivers, food_listings, claims) in, a catalogue of
named metrics out, each one a lazy Spark DataFrame.
"""

from gleaner.tables import Tables

__all__ = ["Tables"]
