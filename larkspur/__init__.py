"""Larkspur: a Spark-native engine for lead-intelligence and corpus data."""
