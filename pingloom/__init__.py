"""Sonar survey analytics and corpus preparation on Apache Spark."""
