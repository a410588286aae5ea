"""Spark-native stochastic panel simulation and training-data operators."""
