"""Column-expression helpers (JVM-side built-ins only, no Python UDFs)."""

from vellum.functions.text import strip_whitespace, title_case, normalise_name  # noqa: F401
from vellum.functions.numeric import (to_number, to_timestamp, nan_to_null,  # noqa: F401
                                      apply_function, safe_ratio, is_numeric_type,
                                      is_datetime_type, is_string_type, kind_of)
from vellum.functions.nested import safe_get  # noqa: F401
