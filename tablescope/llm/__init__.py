"""Operations for training-data pipelines (deduplication, language, packing, search, archives).

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
