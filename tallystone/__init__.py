"""Tallystone: a PySpark-native engine for provenance-preserving evidence data."""
