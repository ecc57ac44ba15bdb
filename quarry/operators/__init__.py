"""Relational, mining, graph and recommender operators: DataFrames in, DataFrames out."""
