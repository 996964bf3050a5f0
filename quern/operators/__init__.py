"""Relational operators: fusion, ranking, graph and enrichment steps over DataFrames."""
