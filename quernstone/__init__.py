"""quernstone: a PySpark-native engine that mills raw text corpora into training datasets."""

__version__ = "0.1.0"
