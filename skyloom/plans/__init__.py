"""Plan-level helpers: shared tables, skew-safe joins, numbering, quantiles, checks."""
