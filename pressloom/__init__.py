"""PySpark-native news-intelligence analytics: every operator is a function over DataFrames."""
