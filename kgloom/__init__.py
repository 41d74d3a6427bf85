"""kgloom: a Spark-native engine for knowledge-graph analytics over chats, notes and documents."""

__version__ = "0.1.0"
