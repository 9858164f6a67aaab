"""Corpus audit and provider-evaluation analytics on Spark DataFrames."""

from corpuseval.session import get_spark, materialize, scratch_dir

__all__ = ["get_spark", "materialize", "scratch_dir"]
