"""Training-data operators: scans, deduplication, classifiers and tokenization for text corpora.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
