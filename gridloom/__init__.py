"""gridloom: a PySpark-native engine for dense numerical arrays held as tables."""
