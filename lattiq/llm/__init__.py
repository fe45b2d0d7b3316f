"""Training-data operators (tokenisers, near-duplicates, decontamination, models).

Nothing outside this subpackage imports it; the queries are in ``queries``.
"""
