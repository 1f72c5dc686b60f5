"""sparkloom: a Spark-native hybrid retrieval and analytics engine."""

__version__ = "0.1.0"
