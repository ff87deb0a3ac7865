"""quillstone: a Spark-native engine for content recommendation and text enrichment."""

__version__ = "0.1.0"
