"""weblode: tables out of stored web responses, as Spark DataFrame plans.

Everything starts from responses that are already stored; nothing here
fetches.  Layout:

``functions``  Column expressions (urls, text, json)
``sources``    scans that lift stored bytes and text into tables
``operators``  DataFrame -> DataFrame building blocks
``plans``      composed jobs a user runs
``streaming``  the jobs that continue as Structured Streaming queries
``catalog``    the registered queries, each with its SQL twin
"""
