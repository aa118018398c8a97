"""Behavioural analytics on PySpark: DataFrame-to-DataFrame operators."""
