"""The texts of results that must equal the reference's, word for word.

Kept together here, in the order the reference emits them. Templates use Java
format syntax (%s, %d) because Spark's ``format_string`` fills them on the
executors; ``{}`` placeholders are filled on the driver with ``str.format``.
"""

# -- quality rule results -------------------------------------------------------
RULE_PASSED = "Rule '%s' passed."
RULE_FAILED = "Rule '%s' failed for column '%s' on %d rows."
TABLE_EMPTY = "DataFrame is empty."
RULE_TYPE_MISSING = "Missing rule_type."
RULE_ERROR = "Error executing rule: {}"
RULE_UNEXPECTED_ERROR = "Unexpected error: {}"

# -- cleaning suggestions -------------------------------------------------------
MISSING_ISSUE = "Missing Values"
MISSING_DETAILS = "Column '%s' has %d missing values (%s%%)."
MISSING_RATIONALE = ("Suggesting '{strategy}' imputation for '{column}'. Consider alternatives like mean, "
                     "constant, or dropping.")
DUPLICATES_ISSUE = "Duplicate Rows"
DUPLICATES_DETAILS = "Found %d complete duplicate rows (%s%%)."
DUPLICATES_RATIONALE = "Dropping duplicates ensures each record is unique."
NUMERIC_ISSUE = "Potential Numeric Type"
NUMERIC_DETAILS = "Column '{column}' (object type) might be convertible to numeric."
NUMERIC_RATIONALE = "Converting to numeric enables calculations and analysis."
DATETIME_ISSUE = "Potential Datetime Type"
DATETIME_DETAILS = "Column '{column}' (object type) might be convertible to datetime."
DATETIME_RATIONALE = "Converting to datetime enables time-based analysis."
CATEGORY_ISSUE = "Potential Categorical Type"
CATEGORY_DETAILS = "Column '{column}' (object) has relatively few unique values."
CATEGORY_RATIONALE = "Converting to 'category' can save memory and improve performance."
STRING_ISSUE = "Potential String Cleaning Needed"
STRING_DETAILS = "Column '{column}' is object type. Check for leading/trailing spaces or inconsistent casing."
STRING_RATIONALE = "Standardizing strings ensures consistency."

# -- feature suggestions --------------------------------------------------------
DATE_PARTS_DETAILS = "Extract time components from '%s'."
DATE_PARTS_RATIONALE = "Temporal patterns are often predictive or cyclical."
INTERACTION_DETAILS = "Create interaction: '%s' * '%s'."
INTERACTION_RATIONALE = "May capture synergistic effects."
GROUP_AGG_DETAILS = "Aggregate '%s' grouped by '%s'."
GROUP_AGG_RATIONALE = "Captures group-level behavior."
BINNING_DETAILS = "Discretize '%s' into bins."
BINNING_RATIONALE = "Can capture non-linear relationships."
ENCODING_DETAILS = "Encode categorical: '%s'."
ENCODING_RATIONALE = "Needed for many ML models."
POLYNOMIAL_DETAILS = "Generate polynomial features (degree 2) for %d column(s)."
POLYNOMIAL_RATIONALE = "Capture non-linear interactions between numeric features."
NO_SUGGESTIONS = "No Suggestions"
NO_SUGGESTIONS_DETAILS = "Could not generate suggestions."

# -- anomalies ------------------------------------------------------------------
OUTLIER_TYPE = "Statistical Outlier"
OUTLIER_DETAILS = "%d potential outliers detected in '%s' (Z-score > %s). Max value: %s, Mean: %s."
TREND_TYPE = "Trend Change"
TREND_DETAILS = "Significant recent %s detected in rolling average for '%s' (Change: %s, StdDev: %s)."
SEVERITY_MEDIUM = "Medium"

# -- relationships ----------------------------------------------------------------
JOIN_KEY_REASON = "Name match ('%s') + Type compatible (%s/%s)"
RELATIONSHIP_RATIONALE = "Heuristic: Name match ('%s') & Type compatible (%s/%s)"

# -- segments and KPIs --------------------------------------------------------------
SEGMENT_LABEL = "Segment "
NOT_AVAILABLE = "N/A"
