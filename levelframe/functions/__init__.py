"""Column functions: line geometry, binning, verdicts, names."""
