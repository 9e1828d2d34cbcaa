"""Panel analytics on Spark: DataFrame-in, DataFrame-out operators over (entity, time) tables."""
