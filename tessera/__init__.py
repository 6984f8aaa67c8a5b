"""tessera: a PySpark-native analytics engine for source-code corpora and training text."""
