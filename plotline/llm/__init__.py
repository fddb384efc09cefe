"""Training-data operators: one module for each operator.

Nothing else in the package imports this folder.
"""
