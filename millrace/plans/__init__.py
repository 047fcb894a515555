"""Registered queries: operators applied to the bound test tables, each beside its SQL twin."""
