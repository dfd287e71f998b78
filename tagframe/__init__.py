"""tagframe: a Spark-native engine for dynamically tagged entities."""
