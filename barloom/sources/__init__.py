"""Readers: daily feeds, universe lists, catalog tables and bars derived from order lines."""
