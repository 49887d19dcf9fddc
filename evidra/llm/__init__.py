"""Training-data operators: one module each, registered in :mod:`evidra.llm.registry`."""
