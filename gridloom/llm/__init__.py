"""Operations of a large-scale training-data pipeline.

Ten operators over a ``documents``-shaped table (an integer id and a text) plus the registry of their
queries.  Nothing outside this subpackage imports it.
"""
