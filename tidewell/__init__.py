"""Tidewell: target-trial and training-data operators written as Spark jobs."""
