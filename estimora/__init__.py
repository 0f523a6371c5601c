"""Estimora: software-test planning analytics and corpus processing on Spark."""
