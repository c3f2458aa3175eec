"""PySpark-native analytics of longitudinal code-production panels."""
