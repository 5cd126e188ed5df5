"""A PySpark engine for long acoustic and other level-type time series."""
