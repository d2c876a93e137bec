"""Prediction-market analytics as Spark DataFrame and Structured Streaming operators."""
