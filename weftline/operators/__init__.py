"""Data operators: every one takes and returns DataFrames and builds a plan; nothing is collected."""
