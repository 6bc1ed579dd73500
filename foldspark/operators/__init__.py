"""DataFrame operators. Every operator takes column names as arguments and
returns a lazy DataFrame; statistics are computed by aggregates whose result
size is bounded by the number of groups, then joined back."""
