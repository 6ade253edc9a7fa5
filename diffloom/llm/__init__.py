"""Operators of a training-data pipeline and their registered queries.

Nothing else in the library imports this subpackage.  ``queries.REGISTRY`` has the
queries; every operator module can be used on its own.
"""
