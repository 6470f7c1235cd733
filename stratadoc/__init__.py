"""stratadoc: a PySpark-native document-intelligence engine."""
