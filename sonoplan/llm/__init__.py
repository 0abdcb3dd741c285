"""Training-data pipeline operators: dedup, decontamination, mixing, scoring, scanning."""
