"""Change-history analytics on Spark DataFrames.

Two halves share one data model:

* histories ("trails"): named, ordered lists of events that can be created,
  listed, looked up, appended to and replayed from a sequence number;
* change capture: an ordered log of decoded database change messages is turned
  into committed transactions, row changes and one checkpoint per source slot.

Every operator takes and returns DataFrames and is built from Spark's own
functions; nothing here runs Python per row.
"""
