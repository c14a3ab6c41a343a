"""Training-data operators for text corpora, embeddings and dialogues.

Ten operators, one module each.  Every operator takes and returns DataFrames,
keeps its general interface here, and has a thin query in ``queries``.
Nothing else in the library imports this subpackage.
"""
