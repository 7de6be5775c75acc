"""A Spark-native engine for quads, SPARQL and rules."""
