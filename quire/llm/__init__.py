"""Training-data operators: filters, classifiers, near-duplicate joins, archives, mixing.

Each module holds one operator with its own general interface; ``queries``
applies them to the given tables.  Nothing outside this package imports it.
"""
