"""sensorloom: multimodal sensor analytics as PySpark DataFrame operators.

``sources``    scans, session listings, checksums, sinks and the feature cache
``functions``  column expressions shared by the operators
``operators``  DataFrame -> DataFrame building blocks (windows, features, heads, fusion, metrics)
``plans``      compositions: the paired feature table, the whole study, the registered queries
"""
