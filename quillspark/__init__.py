"""A PySpark-native engine for authorship attribution, verification and style-change detection."""
