"""prismwell: DataFrame operators that build, audit and clean training data on Spark."""
