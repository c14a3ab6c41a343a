"""PySpark-native analytics for physiological time series at cohort scale."""
