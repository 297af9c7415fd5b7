"""Operators for large training-text corpora. Each module holds one operator with a general
interface; ``queries`` registers the production query of each. Nothing outside this folder
(but for ``corpus_pipeline.py``) imports it."""
