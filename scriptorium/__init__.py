"""Spark-native bibliometric analytics: every analysis is a ``DataFrame -> DataFrame`` function."""
