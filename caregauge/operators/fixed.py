"""Labels, limits and sizes that existing reports use and results must share."""

# Trend of a month against the one before.
TREND_LABELS = ("Growth", "Decline", "Flat")

# Insurer coverage in percent: portfolio table, then chart.
COVERAGE_LABELS = ("High Coverage", "Medium Coverage", "Low Coverage")
COVERAGE_LIMITS = (70, 40)
COVERAGE_BANDS = ("good", "moderate", "low")
COVERAGE_BAND_LIMITS = (60, 35)

# Visits per patient: exactly 1, exactly 2, up to 4, more.
VISIT_LABELS = ("1 Visit (One-time)", "2 Visits", "3–4 Visits", "5+ Visits (High Value)")

# Patient age, upper limits exclusive.
AGE_LABELS = (
    "0–17 Pediatric",
    "18–34 Young Adult",
    "35–54 Middle Age",
    "55–69 Senior",
    "70+ Elderly",
)
AGE_LIMITS = (18, 35, 55, 70)

# Average stay of a department in days.
STAY_BANDS = ("long", "medium", "short")
STAY_LIMITS = (5, 3)

# Doctor tiers: above the upper quartile, above the median, the rest.
TIER_LABELS = ("Top", "Good", "Avg")

# Attribution quadrants.
HIDDEN_STAR = "Hidden Star"
OVERLOADED = "Overloaded"
SOLID = "Solid"
QUALITY_GAP = "Quality Gap"

# Patient segments.
HIGH_VALUE = "High Value"
FREQUENT = "Frequent"
COMPLEX_CARE = "Complex Care"
LOW_ENGAGEMENT = "Low Engagement"

# Limits of flags and verdicts.
READMISSION_RISK = 0.15
IMPORTANT_FEATURE = 0.15
CORRELATION_LIMIT = 0.1
SUCCESS_BENCHMARK = 90

# Smallest groups and lengths of lists.
MIN_SEVERITY_ROWS = 20
MIN_DIAGNOSIS_CASES = 15
TOP_SEVERITY_CELLS = 20
TOP_PROCEDURES = 20
TOP_DIAGNOSES = 25
TOP_INSURERS = 8
TOP_DOCTORS = 10
TOP_TIER_DOCTORS = 30
TOP_DEPARTMENTS = 3

# Ten million, the unit of large amounts.
CRORE = 1e7

# Columns of the published score table.
SCORE_COLUMNS = (
    "doctor_name",
    "specialization",
    "experience_years",
    "n_patients",
    "actual_readmit_rate",
    "expected_readmit_rate",
    "attribution_score_norm",
    "complexity_score",
    "recovery_rate",
    "revenue_generated",
    "quadrant",
    "rank_shift",
)

# Inputs and settings of the readmission forest.
FOREST_FEATURES = (
    "age",
    "department_code",
    "severity_code",
    "bed_code",
    "admission_type_code",
    "gender_code",
    "length_of_stay",
    "total_bill",
    "insurance_covered",
    "patient_paid",
    "month",
)
FOREST_TREES = 150
FOREST_DEPTH = 7
FOREST_SEED = 42
TEST_BUCKETS = 5  # one in five is held out

# Inputs of the expected-risk regression.
RISK_FEATURES = (
    "age",
    "severity_code",
    "department_code",
    "diagnosis_code",
    "bed_code",
    "admission_type_code",
    "gender_code",
    "length_of_stay",
    "total_bill",
    "month",
)
