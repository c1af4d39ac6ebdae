"""Plan building blocks: one-pass aggregates, exact quantiles, row order without one-task windows, lookups."""
