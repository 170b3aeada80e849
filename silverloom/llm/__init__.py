"""Operators for preparing large text corpora: one module an operator, queries in ``queries``."""
