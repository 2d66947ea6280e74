"""textquarry: Spark-native building, filtering, sampling and evaluation of text corpora."""

__version__ = "0.1.0"
