"""Training-data operators (ten of them) and the queries that apply them to whole tables.

Nothing outside this folder imports it, apart from the guarded wiring in ``__spark_entry__``.
"""
