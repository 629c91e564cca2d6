"""Time-series feature extraction on Spark."""
