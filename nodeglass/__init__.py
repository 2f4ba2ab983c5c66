"""nodeglass: telemetry analytics for device fleets, written on Spark DataFrames.

Sub-packages
------------
functions   column expressions (decode, labels, load resolution, display)
sources     readers, writers, exports and the views over the test tables
operators   DataFrame -> DataFrame building blocks
plans       named reports and batch jobs composed of operators
streaming   Structured Streaming ingest and running state
"""
