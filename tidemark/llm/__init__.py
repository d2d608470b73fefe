"""Training-data operators: ten standalone modules, their queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
