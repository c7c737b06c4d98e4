"""Training-data operators: ten corpus operators over a ``documents`` table.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only if it is there.
"""
