"""Column expressions over sequences."""
