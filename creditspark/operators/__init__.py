"""Table operators: loan history windows, joins, summaries, macro series, validation."""
