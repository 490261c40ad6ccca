"""DataFrame operators: joins, aggregates, runs, windows, audits, models."""
