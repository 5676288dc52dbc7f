"""Operators of a training-data pipeline; nothing else in the library imports them.

``toxicity``, ``neighbours``, ``licenses``, ``warc``, ``simhash``, ``bpe``,
``urls``, ``decontaminate``, ``pitman_yor``, ``language``, ``substrings``,
``repair`` and ``trie`` hold one operator each; ``queries`` registers ``op1_`` to
``op13_``.
"""
