"""A Spark-native engine for panel time series and corpus preparation."""
