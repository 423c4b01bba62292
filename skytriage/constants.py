"""Fixed values shared with the upstream semantics; plain text, one place.

These must equal the published behaviour for results to agree.
"""

# --- Size buckets, half-open [lo, hi) in sqrt(area) pixels -----------------------
BUCKETS = (
    ("<8px", 0.0, 8.0),
    ("8-16px", 8.0, 16.0),
    ("16-32px", 16.0, 32.0),
    (">32px", 32.0, float("inf")),
)
BUCKET_LABELS = tuple(name for name, _, _ in BUCKETS)
SMALL_BUCKETS = ("<8px", "8-16px")

# --- Object classes -------------------------------------------------------------
CLASSES = ("drone", "bird", "aircraft", "unknown")
TEXT_VOCAB = {
    "drone": "drone", "uav": "drone", "bird": "bird",
    "airplane": "aircraft", "aircraft": "aircraft", "helicopter": "aircraft",
}
XML_VOCAB = TEXT_VOCAB | {"aeroplane": "aircraft"}
COCO_CATEGORY_IDS = {"drone": 1, "bird": 2, "aircraft": 3, "unknown": 4}

# --- Evaluation -----------------------------------------------------------------
AP_SWEEP = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
OPERATING_CONFIDENCE = 0.25
CONFIDENCE_EDGES = (0.0, 0.25, 0.5, 0.7, 0.8, 0.9, 1.01)
Z_95 = 1.959963984540054

# --- Small-sample flags: five different rules, five names -----------------------
MIN_FOOTAGE_HOURS = 0.5
MIN_EVAL_BOXES = 30
MIN_TRACKS_PER_BUCKET = 30
MIN_TRACKS_PER_CLASS = 50
MIN_TRACKS_TO_TRAIN = 20
MIN_CLIPS_PER_CLASS = 3
MIN_NEGATIVE_SHARE = 0.02

# --- Motion features ------------------------------------------------------------
MIN_OBSERVATIONS = 8
HOVER_SPEED = 0.5
FEATURES = (
    "mean_speed", "speed_variance", "acceleration_variance",
    "vertical_oscillation_hz", "vertical_oscillation_power", "heading_entropy",
    "hover_fraction", "trajectory_smoothness", "scale_change_rate",
)

# --- Triage ---------------------------------------------------------------------
FLAP_HZ = (2.0, 8.0)
MIN_OSCILLATION_POWER = 0.35
MIN_HOVER_SECONDS = 3.0
MIN_TRACK_SECONDS = 2.0
SMALL_TARGET_PX = 20.0
MAX_DETERMINED_INTERVAL = 0.30
MIN_DISMISS_CONFIDENCE = 0.75
ACTION_BUDGET = 4

# --- Media limits ---------------------------------------------------------------
MEDIA_LIMITS = {"side": 4096, "fps": 120.0, "seconds": 300.0, "work": 4.0e10}
