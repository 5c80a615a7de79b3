"""Operators for preparing training text: scans, filters, de-duplication, packing, scoring.

Every operator takes a DataFrame and the names of its columns, reads whole texts and returns
a DataFrame. Nothing outside this subpackage imports it.
"""
