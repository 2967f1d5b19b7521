"""Event-log analytics, labelled anomalies and prefix anomaly detection on Spark DataFrames."""
