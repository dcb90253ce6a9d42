"""A Spark-native engine for RDF data with named graphs."""
