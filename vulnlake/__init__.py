"""Vulnerability-intelligence jobs as Spark DataFrame operators."""
