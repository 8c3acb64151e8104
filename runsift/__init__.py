"""Run-triage analytics on Spark: typed run records, risk models, ranking and offline policy checks."""
