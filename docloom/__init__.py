"""docloom: a Spark-native engine that ingests, cleans, scores, searches and summarises collections of documents."""

__version__ = "0.1.0"
