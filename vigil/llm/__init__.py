"""Training-data operators: dedup, tokenising, toxicity, packing, archives.

Nothing else in the library imports this subpackage.  General conventions:

* a null text counts as the empty text, a null id is an id like any other;
* operators read only the columns they name, so extra input columns (also ones
  that share a name with an internal column) never clash;
* frames that are read twice are written as Parquet to the shared folder that
  ``spark.checkpoint.dir`` names, so a lost executor costs a re-read.
"""
