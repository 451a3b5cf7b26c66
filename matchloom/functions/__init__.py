"""Column functions: text, statistics, pair predicates."""
