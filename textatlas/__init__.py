"""textatlas: a PySpark-native text-analytics engine."""
