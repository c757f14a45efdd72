"""Models of the loan decision, fitted by aggregates over all rows."""
