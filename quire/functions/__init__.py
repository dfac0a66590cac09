"""Column resolution (metadata only) and Column-level coders.

Everything here returns ``pyspark.sql.Column`` expressions or plain Python over
``df.columns``; nothing triggers a job.
"""
from quire.functions.columns import (  # noqa: F401
    find_column, find_case_sensitive, find_numeric_column, present_columns,
    unique_names, columns_with_prefix, quote, normalise_header,
)
from quire.functions.coders import (  # noqa: F401
    yes_no, administered_flag, sex_male, laterality, three_level_response,
    cognitive_status, number_in_parentheses, first_number, label_map,
    either_flag,
)
from quire.functions.numeric import (  # noqa: F401
    lenient_double, clip, min_max_scale, z_score, safe_ratio, row_sum_min_count,
    any_not_null, nan_to_zero, hellinger_from_sums,
)
