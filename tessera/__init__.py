"""tessera: retrieval, knowledge-graph and evaluation analytics as PySpark DataFrame plans."""
