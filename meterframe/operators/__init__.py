"""DataFrame operators: readings, contracts, pricing, merge, roll-ups, report."""
