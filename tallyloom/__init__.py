"""Tallyloom: text counting and job-run analytics as PySpark DataFrame operators."""
