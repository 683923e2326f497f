"""Training-data operators: scoring, archives, rules, joins, mixing and encoding of text corpora.

Nothing outside this subpackage imports it; the whole folder can be removed.
"""
