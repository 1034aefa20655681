"""formbook: point-in-time analytics over repeated contests, on Spark DataFrames."""

CONTEST = ("year", "round")
