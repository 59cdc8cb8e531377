"""Fixed values that results depend on.

FIXED VALUES — these lists, tables, patterns, thresholds and message formats
must equal the behaviour being reproduced; they are stated plainly, in their
natural order, and turned into tiny DataFrames by ``vigil.sources.dimensions``.
"""

# --- FIXED VALUES: article ingest ------------------------------------------
CRIME_CATEGORIES = ["murder", "robbery", "assault", "theft", "shooting", "crime"]

SENTENCE_KEYWORDS = ["robbery", "theft", "murder", "assault", "rape", "crime",
                     "shooting", "killed", "attacked", "stolen", "robbed"]

# Ordered: the first pattern that matches in a sentence wins.
LOCATION_PATTERNS = [
    r"occurred\s+(?:in|at|near)\s+([^\.]+)",
    r"took\s+place\s+(?:in|at|near)\s+([^\.]+)",
    r"happened\s+(?:in|at|near)\s+([^\.]+)",
    r"reported\s+from\s+([^\.]+)",
    r"in\s+([^,\.]+)",
]

KEYWORD_MAX_GAP = 5          # place must be strictly closer than 5 tokens
PAGE_SIZE = 100              # articles kept per category query
DEFAULT_LANG = "en"
DEFAULT_DAYS_BACK = 7
UNKNOWN_SOURCE = "Unknown"

FILL_DEFAULTS = {
    "description": "No description available",
    "source": "Unknown Source",
    "location_name": "Unknown Location",
    "category": "Unknown Category",
}
# Formats of publication dates given as text, the first that fits counts
TEXT_DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd"]
POPUP_NO_DESCRIPTION = "No description available"
POPUP_DESCRIPTION_CHARS = 200

# --- FIXED VALUES: prediction ----------------------------------------------
GRID_RESOLUTION = 0.01
HOT_PERCENTILE = 0.75
PREDICTION_DAYS = 7
VIOLENT_CATEGORIES = ["murder", "assault", "shooting"]
UNKNOWN_LOCATION = "Unknown"

RISK_FACTOR_WEIGHTS = [
    ("population_density", 0.25),
    ("poverty_rate", 0.2),
    ("unemployment", 0.15),
    ("vacant_buildings", 0.1),
    ("lighting_quality", 0.1),
    ("police_presence", -0.15),
    ("community_programs", -0.1),
    ("weather_conditions", 0.05),
]

DEFAULT_REGION = "default"
DEFAULT_SIMILAR_REGION = "global"
DEFAULT_REGION_WEIGHT = 1.0

# --- FIXED VALUES: interventions -------------------------------------------
# (type, description, base effectiveness)
INTERVENTION_TYPES = [
    ("police_patrol", "Strategic police patrol deployment", 0.75),
    ("community_outreach", "Community engagement and education programs", 0.65),
    ("environmental_modification",
     "Physical environment improvements (lighting, cameras, etc.)", 0.70),
    ("public_awareness", "Targeted public awareness campaigns", 0.60),
    ("targeted_enforcement", "Focused enforcement on specific crime types", 0.80),
]
CUSTOM_INTERVENTION = ("Custom intervention", 0.5)

HIGH_RISK = 0.7
MEDIUM_RISK = 0.4
# band -> (priority, effectiveness factor)
BAND_FACTORS = [("high", 1.0), ("medium", 0.8), ("low", 0.6)]
BAND_COLOURS = [("high", "red"), ("medium", "orange"), ("low", "green")]
PEAK_RISK = 0.7
RECENT_RUNS = 5
TRACKER_NO_BASELINE = 0.5

# crime type -> two (intervention type, actions) in order; "*" is the default.
INTERVENTION_RULES = [
    ("theft", "police_patrol", [
        "Increase visible patrol during peak hours",
        "Deploy plainclothes officers in high-risk areas",
        "Establish police substations in hotspot areas"]),
    ("theft", "environmental_modification", [
        "Improve lighting in vulnerable areas",
        "Install security cameras at key locations",
        "Use crime prevention through environmental design (CPTED) principles"]),
    ("assault", "police_patrol", [
        "Deploy officers during nightlife hours",
        "Focus patrol near bars and entertainment venues",
        "Implement rapid response protocols for violent incidents"]),
    ("assault", "community_outreach", [
        "Establish violence prevention programs",
        "Conduct conflict resolution workshops",
        "Partner with local businesses for safety initiatives"]),
    ("violence", "police_patrol", [
        "Deploy officers during nightlife hours",
        "Focus patrol near bars and entertainment venues",
        "Implement rapid response protocols for violent incidents"]),
    ("violence", "community_outreach", [
        "Establish violence prevention programs",
        "Conduct conflict resolution workshops",
        "Partner with local businesses for safety initiatives"]),
    ("burglary", "environmental_modification", [
        "Improve property security measures",
        "Install neighborhood watch signage",
        "Address abandoned properties and urban blight"]),
    ("burglary", "public_awareness", [
        "Distribute home security checklists",
        "Hold community meetings on burglary prevention",
        "Create a neighborhood alert system"]),
    ("*", "police_patrol", [
        "Increase patrol frequency in hotspot areas",
        "Coordinate with neighboring jurisdictions",
        "Use data-driven deployment strategies"]),
    ("*", "community_outreach", [
        "Hold regular community safety meetings",
        "Create neighborhood watch programs",
        "Implement anonymous tip reporting systems"]),
]
PEAK_ENFORCEMENT_TYPE = "targeted_enforcement"
PEAK_HOURS_TEMPLATE = "Focus resources during peak hours: %s"
PEAK_DAYS_TEMPLATE = "Increase coverage on high-risk days: %s"

# --- FIXED VALUES: validation ----------------------------------------------
ACCURACY_THRESHOLD = 0.7          # pass if overall > threshold (strict)
EFFECTIVENESS_THRESHOLD = 0.3     # rule if average < threshold
FPR_THRESHOLD = 0.2               # rule if rate > threshold
MIN_RESULTS_FOR_RULE = 3
MIN_HIGH_FPR_RUNS = 3
TREND_RUNS = 3
HIT_DISTANCE = 0.05               # degrees, strict "<"
VALIDATION_BIN = 0.01
# spatial, type, correlation, (1 - false positive rate)
OVERALL_WEIGHTS = (0.4, 0.3, 0.2, 0.1)

MSG_ACCURACY_DECLINE = ("Prediction accuracy is declining. "
                        "Consider model retraining with recent data.")
MSG_LOW_EFFECTIVENESS = ("The '%s' intervention has low effectiveness (%.2f). "
                         "Consider adjusting strategy or implementation.")
MSG_HIGH_FPR = ("High false positive rate detected. "
                "Consider adjusting model sensitivity and adding more features.")

# --- FIXED VALUES: map layers ----------------------------------------------
# category (lower case) -> marker colour; anything else is red.
CATEGORY_MARKERS = [
    ("theft", "blue"),
    ("assault", "red"),
    ("robbery", "orange"),
    ("shooting", "darkred"),
    ("murder", "black"),
]
DEFAULT_MARKER = "red"
MISSING_HEAT_WEIGHT = 0.5
