"""Operations of a large-scale training-data pipeline, one module an operator.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
registered queries; every operator keeps a general interface of its own.
"""
