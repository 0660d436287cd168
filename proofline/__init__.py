"""Bulk document review on PySpark: blocks, located issues, and the relational work around them."""
