"""Spark-native estimation of post-mortem DNA damage, with read scoring and decontamination."""
