"""sungrid: keyed time-series analytics written with the Spark DataFrame API."""
