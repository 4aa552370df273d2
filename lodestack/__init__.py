"""lodestack: a Spark-native engine for analysing content-addressed, versioned, multi-author workspaces."""

__version__ = "0.1.0"
