"""Foliant: a PySpark-native document-intelligence engine."""
