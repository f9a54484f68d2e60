"""Operators for large text corpora (training-data preparation).

Each module holds one operator and works on plain DataFrames.  Shared rules for all of them:

* words are maximal runs of characters other than space and ``\\t\\n\\v\\f\\r``;
* a null text is treated as an empty text and a null id is an id of its own (one value);
* extra columns of the input are never read, so they may have any names;
* an empty table gives an empty result with the same schema;
* intermediate tables go to the cluster's shared checkpoint folder (``common.store``).

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
