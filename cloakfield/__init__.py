"""Security-event analytics, pseudonymisation and training-data preparation on Spark DataFrames."""
