"""Column expressions carrying pandas / Python semantics, as SQL text builders
(``*_sql``) and a few ``Column`` forms."""

from pitchside.functions.numeric import (  # noqa: F401
    nan_to_null_sql, pandas_divide, pandas_divide_sql, per90_term_sql, skipna_sum_sql, trunc_to_long_sql,
)
from pitchside.functions.pixels import band_mask_sql, gray_sql, hsv_from_bgr, hsv_sql, in_hsv_range_sql  # noqa: F401
from pitchside.functions.sql import dbl, lit_str, project, q, run_sql, with_columns  # noqa: F401
from pitchside.functions.text import (  # noqa: F401
    contains_ci_sql, first_word, first_word_sql, parse_date_sql, py_fixed, py_fixed_sql, py_float, py_float_sql,
    py_int, py_int_sql, py_isdigit_sql, py_str_double, py_strip, py_strip_sql, with_py_str,
)
