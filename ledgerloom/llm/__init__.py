"""Operators for preparing training corpora: one module an operator, queries in ``queries``."""
