"""Behavioural traffic-anomaly analytics on Spark."""
