"""contentflow: content ingestion and text analytics as Spark DataFrame plans.

``sources``    readers and writers (posts, pages, feeds, dataset releases)
``functions``  column expressions (markup, text, dates, record walking)
``operators``  DataFrame -> DataFrame operators
``streaming``  the incremental forms of the ingest operators
``plans``      whole flows composed from the operators
``workload``   the operators bound to the test tables, with the SQL that checks them
"""

__version__ = "0.1.0"
