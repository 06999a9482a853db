"""lodekey: a PySpark-native engine for keyed item collections."""
