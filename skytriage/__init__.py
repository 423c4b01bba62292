"""Detections to tracks to triage, as DataFrame operators on Spark.

Every public operator takes and returns DataFrames. Import operators from the
submodules (``skytriage.operators.features`` and so on).
"""
