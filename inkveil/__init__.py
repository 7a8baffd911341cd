"""inkveil: document sanitization on Spark.

Personal data in tables of documents is found, numbered per document and
replaced with DataFrame expressions; see README.md for the operator list.
"""
