"""Training-data operators: ten operators over documents, pages and conversations.

Nothing outside this package and corpus_pipeline.py imports it.
"""
