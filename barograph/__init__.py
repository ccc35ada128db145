"""Barograph: time-series analytics and evaluation queries as Spark DataFrame operators."""
