"""Plan-level helpers: shared tables, iteration, skew-safe numbering."""
