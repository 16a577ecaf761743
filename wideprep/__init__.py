"""wideprep: Spark-native preparation of wide client shipment tables.

Every operator is a ``DataFrame -> DataFrame`` function made of native
Spark expressions, joins, windows and aggregates.
"""

__version__ = "0.1.0"
