"""pennyworks: a Spark-native analytics engine for double-entry ledgers."""
