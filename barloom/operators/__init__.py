"""DataFrame-to-DataFrame operators on the (symbol, date) panel."""
