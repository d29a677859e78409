"""Panel analytics on Spark: DataFrame-to-DataFrame operators over long (entity, time, value) tables."""
