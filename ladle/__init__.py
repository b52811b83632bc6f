"""Recipe-data analytics on Spark: operators are DataFrame -> DataFrame or Column -> Column functions."""
