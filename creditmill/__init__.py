"""Consumer-lending batch analytics on Spark DataFrames.

``functions``  column expressions (cleaning rules and scoring points)
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers and writers: delimited files, zones, manifest, catalog
``plans``      the silver, quarantine, wide-view and scoring jobs built from them
"""
