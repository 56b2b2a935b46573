"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps extra columns out of its way by selecting the columns it
needs, and reads the corpus only through Spark.
"""
