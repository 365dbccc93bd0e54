"""Market-data analytics on PySpark: ticks, bars, features, signals, studies, logs."""
