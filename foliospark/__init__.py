"""Foliospark: a Spark-first engine for curating collected text, pages and ledgers."""
