"""Trade-outcome analytics as Spark logical plans: DataFrame in, DataFrame out."""
