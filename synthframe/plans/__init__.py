"""Registered queries: each operator over the driver tables, with the equivalent SQL."""
