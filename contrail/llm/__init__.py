"""Operators for preparing language-model training data at scale.

Nothing outside this folder imports it. Every operator takes and returns
Spark DataFrames; helpers that run inside tasks use numpy and Arrow batches.
"""
