"""Training-data operators.

Nothing else in the library imports this package.  Each operator is a module
with one public function that takes DataFrames and returns a DataFrame, and a
``query(spark, sf_dir)`` that applies it with production parameters to its
whole table.
"""
