"""Operators over corpora: n-grams, bags, vocabularies, retrieval, language models, classifiers, clusters, evaluation, time series."""
