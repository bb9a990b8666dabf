"""Operators for preparing training data at scale.

Nothing outside this folder imports it. Each module is one operator with a
general interface; ``queries`` holds the thin ``opN_*`` queries.
"""
