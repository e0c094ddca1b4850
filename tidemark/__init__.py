"""Tidemark: a PySpark-native analytics engine for market, filing, ownership and news tables."""
