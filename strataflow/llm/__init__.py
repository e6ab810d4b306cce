"""Training-data operators.

Nothing else in the library imports this subpackage; ``__spark_entry__``
registers its queries only when it can be imported.
"""
