"""foldspark: leak-safe tabular feature engineering, out-of-fold scoring,
blending, calibration and error analysis, written as Spark DataFrame jobs.

Sub-packages
------------
sources    table scans, CSV with missing tokens, prediction store, experiment log
functions  column expressions: scalar helpers and the feature recipe
operators  DataFrame -> DataFrame operators (cleaning, folds, encodings,
           group statistics, metrics, blends, calibrations)
plans      end-to-end jobs: fixtures, MLlib k-fold runners, the query catalogue
"""

__version__ = "0.1.0"
