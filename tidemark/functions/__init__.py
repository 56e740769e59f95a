"""Closed-form functions as Spark columns."""
