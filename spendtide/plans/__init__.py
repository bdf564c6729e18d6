"""Whole jobs: the weekly run, the stand-in source and the registered queries."""
