"""Stages over named tables, and the registered queries with their SQL counterparts."""
