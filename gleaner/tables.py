"""The four tables a catalogue query runs over."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    providers: DataFrame
    receivers: DataFrame
    listings: DataFrame
    claims: DataFrame

    def by_name(self) -> dict[str, DataFrame]:
        return {"providers": self.providers, "receivers": self.receivers,
                "food_listings": self.listings, "claims": self.claims}

    def register(self) -> None:
        """Expose the tables as temp views for ``spark.sql``."""
        for name, df in self.by_name().items():
            df.createOrReplaceTempView(name)
