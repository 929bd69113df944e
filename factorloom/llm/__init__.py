"""Corpus operators for training-data pipelines (dedup, tokens, packing, filters).

Nothing else in the library imports this subpackage.  Shared conventions:

* A null ``text`` counts as the empty string.
* ``doc_id`` identifies a row.  Rows that repeat a ``doc_id`` are processed
  like any others; rows whose ``doc_id`` is null are kept by the row-wise
  operators and left out by the grouping ones, where nothing could refer to
  them (each docstring says which).
* Every operator projects the columns it needs first, so further columns of
  any name may be present.
* Intermediate tables go to the shared folder of ``spark.checkpoint.dir``.
"""
