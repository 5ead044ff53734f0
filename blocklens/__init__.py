"""Spark-native log anomaly analytics: parse, mine, sequence, score, alert."""
