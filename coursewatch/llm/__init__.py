"""Operations of a training-data pipeline, one module each.

Nothing outside this package imports it; ``queries`` binds the operators to the
driver's tables.
"""
