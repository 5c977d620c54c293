"""Minimum-vertex-cover analytics and training-data preparation on Apache Spark."""
