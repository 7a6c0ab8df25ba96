"""Spark-native operators for preserved, versioned snapshot archives."""
