"""Content screening as Spark jobs: validate, split, screen, fold, forward, audit."""
