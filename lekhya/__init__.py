"""Lekhya: a PySpark-native document-intelligence and analytics engine."""
