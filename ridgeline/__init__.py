"""Ridgeline: a PySpark-native engine for terrain visibility and site scoring."""
