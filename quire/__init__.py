"""quire: Spark-native operators for wide, keyed, mixed-type cohort tables.

Subpackages
-----------
sources    scans and sinks (keyed CSV, table catalogs, result sets, writers)
functions  column resolution and Column-level coders / numeric helpers
operators  DataFrame operators: dedupe, assembly, profiling, split, preprocessing,
           Hellinger ranking, reducers, metrics, result analytics, models
plans      end-to-end compositions (cohort assembly, experiment, method sweep)
streaming  applying fitted batch models to streaming DataFrames
"""

__version__ = "0.1.0"
