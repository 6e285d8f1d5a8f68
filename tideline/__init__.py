"""Tideline: repeated-measures analytics expressed as Spark plans."""
