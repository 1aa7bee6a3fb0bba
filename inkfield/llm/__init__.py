"""Operations of a training-data pipeline, each a Spark job of its own method.

Nothing else in the library imports this subpackage.
"""
