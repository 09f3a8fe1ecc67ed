"""Fixed values that results depend on: names, weights, bands and thresholds."""

# Task types and checklist items.
TASK_TYPES = ("classification", "regression", "other")

DOCUMENTATION_LABELS = {
    "variable_descriptions": "Variable descriptions",
    "target_definition": "Target definition",
    "data_collection": "Data collection method",
    "collection_period": "Collection period",
    "units_and_categories": "Units and categories",
    "known_limitations": "Known limitations",
}

PROVENANCE_LABELS = {
    "origin": "Data origin",
    "collector": "Data collector",
    "generation_period": "Generation period",
    "transformations": "Applied transformations",
    "version": "Dataset version",
}

# Dimensions in report order.
DIMENSIONS = (
    "Completeness", "Consistency", "Class Balance", "Documentation", "Provenance", "Data Quality",
)

# Default dimension weights per task.
DIMENSION_WEIGHTS = {
    "classification": {
        "Completeness": 7.8, "Consistency": 2.1, "Class Balance": 2.3,
        "Documentation": 2.5, "Provenance": 2.5, "Data Quality": 15.1,
    },
    "regression": {
        "Completeness": 23.5, "Consistency": 3.7,
        "Documentation": 2.5, "Provenance": 2.5, "Data Quality": 33.7,
    },
    "other": {
        "Completeness": 14.5, "Consistency": 2.1,
        "Documentation": 2.5, "Provenance": 2.5, "Data Quality": 20.4,
    },
}

# Lower bound of each readiness band.
SCORE_BANDS = (
    (0, "Not ready"), (50, "Requires preparation"), (75, "Almost ready"), (90, "Ready"),
)

# Indicator thresholds.
ACCEPTABLE_MISSING_SHARE = 0.2
RARE_CLASS_PERCENTAGE = 5
SHOWN_CLASSES = 8

# Indicator names.
FILLED_CELLS = "% filled cells"
FILLED_COLUMNS = "% columns with less than 20% missing"
COMPLETE_ROWS = "% complete rows"
FILLED_IMPORTANT = "% filled in important columns"
UNIQUE_ROWS = "% non-duplicate rows"
CONSISTENT_TYPES = "% columns with consistent types"
UNIFORM_TEXT = "% categorical columns without text variants"
CLASS_RATIO = "Minority-to-majority class ratio"
WITHOUT_OUTLIERS = "% numeric values without outliers"
VARYING_COLUMNS = "% non-constant columns"

# Where a scorecard's weights came from.
DEFAULT_SOURCE, CUSTOM_SOURCE = "study_defaults", "custom"
