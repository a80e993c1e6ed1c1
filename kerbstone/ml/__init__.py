"""Splitting, training and judging the incident classifier with Spark ML."""
