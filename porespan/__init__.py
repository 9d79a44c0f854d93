"""Spark-native analytics for labelled volume time series."""
