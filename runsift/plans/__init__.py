"""Registered queries, one module per operator family, each with its equivalent SQL."""
