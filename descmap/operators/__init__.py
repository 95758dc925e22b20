"""Relational and numeric operators on DataFrames of samples and frames."""
