"""PySpark-native post-processing of page-level document-parsing output."""
