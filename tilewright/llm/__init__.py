"""Training-data operators: ten distributed operators over documents and vectors.

Nothing outside this subpackage imports it; ``registry`` holds the queries.
"""
