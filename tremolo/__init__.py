"""Spark-native analytics of how systems answer when their inputs are perturbed."""
