"""waybill: order-to-delivery analytics as Spark DataFrame jobs.

Public functions take DataFrames and return lazy DataFrames; those that need
several passes stage the first ones when called.  The layers are ``sources``
(scans and sinks), ``functions`` (column expressions), ``operators`` (reusable
DataFrame transformations), ``plans`` (the fact table and the reports over it)
and ``streaming`` (incremental ingestion).
"""
