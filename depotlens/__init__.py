"""Inventory-ledger analytics on PySpark DataFrames.

Every operator takes a mapping of table name -> DataFrame (see ``schemas``) plus
keyword parameters and returns a lazy DataFrame built from built-in functions.
"""
