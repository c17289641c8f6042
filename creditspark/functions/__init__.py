"""Column expressions: cleaning, delinquency rules, loan features, binning."""
