"""Operators that prepare a text corpus for training language models.

Nothing outside this package imports it. `lectern.llm.queries` names the
queries; each problem has a module of its own.
"""
