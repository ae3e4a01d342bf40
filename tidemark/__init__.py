"""Backup-repository analytics on Spark.

Object listings, manifests, sidecars, archived log segments, block images and
change logs go in as DataFrames (or streams); catalogs, plans, mismatch reports
and merged tables come out as DataFrames.
"""

__version__ = "0.1.0"
