"""veilframe: privacy analytics on Spark DataFrames.

Classification, re-identification risk, anonymization, privacy checks,
differentially private aggregates and budget accounting, all expressed as
DataFrame plans.
"""

__version__ = "0.1.0"
