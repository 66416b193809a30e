"""Activity analytics over whole tables with Spark: operators from DataFrame to DataFrame, for all users at once."""
