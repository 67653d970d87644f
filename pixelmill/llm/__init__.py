"""Operators for preparing language-model training corpora.

Each module holds one operator with its own interface; :mod:`pixelmill.llm.queries` applies them to the
corpus tables. Nothing else in the library imports this package.
"""
