"""Drayage: Spark jobs for moving tables between systems.

Discovery, mapping, dataflows, loads, reconciliation, data quality, control
findings, run records, report text and streaming alerts, all as functions that
take and return Spark DataFrames.
"""

__version__ = "0.1.0"
