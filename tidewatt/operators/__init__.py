"""DataFrame operators: grid, windows, joins, metrics, contracts, scenarios."""
