"""Spark-native engine that turns notes and corpora into auditable structured facts."""
