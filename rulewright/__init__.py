"""rulewright: association mining and training-corpus building on Spark DataFrames."""
