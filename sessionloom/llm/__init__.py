"""Training-data operators: filtering, near-duplicate removal, packing, archives and search.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
