"""statforge: a PySpark-native engine for event-level statistics and evidence data."""
