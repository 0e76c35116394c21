"""Lacuna: a Spark-first engine that finds annotated intervals lying in the gaps of a synteny map."""
