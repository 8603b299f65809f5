"""shelfspark: the questions of a library kept over several places, as PySpark plans."""
