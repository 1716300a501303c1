"""A PySpark-native engine for dated panels, pair tables, distribution-valued data and text corpora."""
