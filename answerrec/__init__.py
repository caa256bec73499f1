"""Answerer recommendation on Spark: who is most likely to answer a question."""
