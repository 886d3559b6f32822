"""Operators for preparing training corpora at scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and cuts lineage only with reliable checkpoints or written tables in the folder
that ``spark.checkpoint.dir`` names.
"""
