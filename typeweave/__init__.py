"""Concordance analytics for categorical typing schemes, as Spark jobs."""
