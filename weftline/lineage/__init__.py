"""Lineage of a report model: from sources through queries and columns to report fields, as node and edge DataFrames."""
