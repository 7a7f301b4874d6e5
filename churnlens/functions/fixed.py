"""Fixed values.

These literals must equal the analysis this library reproduces, so they are
stated here plainly, in natural order, in one place. Nothing else in the
package spells them out.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: category labels of the customer table
# ---------------------------------------------------------------------------
ATTRITED = "Attrited Customer"
EXISTING = "Existing Customer"

GENDERS = ("M", "F")

EDUCATION_LEVELS = (
    "Uneducated",
    "High School",
    "College",
    "Graduate",
    "Post-Graduate",
    "Doctorate",
    "Unknown",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: derived bands (inclusive bounds; anything else is NULL)
# ---------------------------------------------------------------------------
AGE_BANDS = (
    ("Younger", 26, 40),
    ("Middle Aged", 41, 55),
    ("Older", 56, 70),
)

UTILIZATION_BANDS = (
    ("Low Use", "0.000", "0.333"),
    ("Medium Use", "0.334", "0.667"),
    ("High Use", "0.668", "0.999"),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: RFM segment grid, recency score r (rows) x combined
# frequency/monetary score fm (columns, 1..5). Every cell has one label.
# ---------------------------------------------------------------------------
SEGMENT_GRID = {
    5: ("Recent Customers", "Potential", "Engaged", "Champions", "Champions"),
    4: ("Promising", "Potential", "Potential", "Engaged", "Champions"),
    3: ("Promising", "Need Attention", "Potential", "Engaged", "Engaged"),
    2: ("About to sleep", "Need Attention", "Need Attention", "At risk", "At risk"),
    1: ("Lost", "Hibernating", "At risk", "Can't lose them", "Can't lose them"),
}

# Segments whose churned customers are profiled in the at-risk report.
AT_RISK_SEGMENTS = ("Hibernating", "Lost", "Promising", "Need Attention", "At risk")

# ---------------------------------------------------------------------------
# FIXED VALUES: cleaning thresholds and RFM parameters
# ---------------------------------------------------------------------------
AGE_OUTLIER = 73            # customer_age deleted outright
TRANS_CT_LIMIT = 133        # total_trans_ct above this is deleted
RFM_BUCKETS = 5             # quintiles
PERCENTILE_BUCKETS = 100    # top-percentile trimming
MONTHS_PER_YEAR = 12        # monthly scaling of frequency / monetary


def segment_cells():
    """(r, fm, label) for all 25 grid cells."""
    for r, row in SEGMENT_GRID.items():
        for fm, label in enumerate(row, start=1):
            yield r, fm, label


SEGMENT_LABELS = tuple(dict.fromkeys(label for _, _, label in segment_cells()))
