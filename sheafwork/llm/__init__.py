"""Operators for preparing the text of large training collections."""
