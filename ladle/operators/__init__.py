"""Operators over DataFrames: linking, taxonomies, flow graphs, triples, scoring, ranking."""
