"""Revisioned-document analytics as DataFrame-to-DataFrame operators on Spark."""
