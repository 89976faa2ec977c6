"""Scalar and array expressions: weighting, vectors, information theory, compositions, stemming, codecs."""
