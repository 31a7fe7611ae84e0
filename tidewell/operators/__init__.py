"""Relational, study-design, causal, bias and scoring operators: DataFrame in, DataFrame out."""
