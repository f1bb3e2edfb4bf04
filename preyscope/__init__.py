"""preyscope: DataFrame operators for bait-prey interaction scoring on Spark."""
