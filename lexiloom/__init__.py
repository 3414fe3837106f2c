"""Corpus statistics and text-structure analytics expressed as Spark plans."""
