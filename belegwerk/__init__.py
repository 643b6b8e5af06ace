"""belegwerk: a searchable text corpus and batch question answering on Spark."""
