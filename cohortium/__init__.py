"""Cohort analytics on Spark: cleaning, filling, modelling and explaining tabular cohorts."""
