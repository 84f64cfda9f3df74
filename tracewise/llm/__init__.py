"""Training-data operators (texts, tokens, licences, personal data, archives).

One module per operator, ``opN_*.py``; ``queries.py`` registers them.  Nothing
outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
