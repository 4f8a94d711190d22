"""Compositions: the cleaning pipeline and the corpus builders."""
