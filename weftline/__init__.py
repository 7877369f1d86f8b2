"""A Spark-native engine for Power Query (M) programs, DAX measures and report lineage."""
