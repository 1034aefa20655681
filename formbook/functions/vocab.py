"""Fixed vocabularies.

The words, codes and thresholds below are fixed values: results agree with
recorded ones only when they are equal.
"""

from __future__ import annotations

# --- result status -> category (fixed values) -------------------------------
FINISHED = "finished"
MECHANICAL = "mechanical"
ACCIDENT = "accident"
DISQUALIFIED = "disqualified"
DID_NOT_START = "did_not_start"
WITHDRAWN = "withdrawn"
NOT_CLASSIFIED = "not_classified"
RETIRED_UNSPECIFIED = "retired_unspecified"
UNKNOWN = "unknown"

STATUS_WORDS = {
    FINISHED: ("finished", "lapped"),
    DID_NOT_START: ("did not start", "did not qualify", "did not prequalify"),
    WITHDRAWN: ("withdrew", "withdrawn"),
    DISQUALIFIED: ("disqualified", "excluded"),
    NOT_CLASSIFIED: ("not classified",),
    RETIRED_UNSPECIFIED: ("retired", "illness", "fatigue"),
    ACCIDENT: ("accident", "collision", "collision damage", "spun off", "damage", "debris"),
    MECHANICAL: (
        "engine", "power unit", "power loss", "turbo", "exhaust", "alternator", "battery",
        "electrical", "electronics", "ers", "mgu-h", "mgu-k", "gearbox", "transmission", "clutch",
        "driveshaft", "differential", "halfshaft", "hydraulics", "oil leak", "oil pressure",
        "fuel pressure", "fuel leak", "fuel pump", "fuel system", "out of fuel", "water pressure",
        "water leak", "water pump", "cooling system", "radiator", "overheating", "suspension",
        "steering", "brakes", "throttle", "wheel", "wheel nut", "puncture", "tyre", "vibrations",
        "mechanical", "technical", "handling", "undertray", "front wing", "rear wing", "bodywork",
        "chassis", "seat",
    ),
}
LAPS_DOWN_PATTERN = r"^\+\d+\s+laps?$"
UNCLASSIFIED_CODES = ("r", "d", "e", "w", "f", "n")

# --- group names -> canonical id (fixed values) ------------------------------
NAME_WORDS = {
    "red_bull": ("red bull racing", "red bull"),
    "mercedes": ("mercedes",),
    "ferrari": ("ferrari",),
    "mclaren": ("mclaren",),
    "williams": ("williams",),
    "haas": ("haas f1 team", "haas"),
    "alpine": ("renault", "alpine"),
    "aston_martin": ("force india", "racing point", "aston martin"),
    "sauber": (
        "sauber", "alfa romeo racing", "alfa romeo", "kick sauber", "stake f1 team kick sauber",
        "audi",
    ),
    "racing_bulls": (
        "scuderia toro rosso", "toro rosso", "alphatauri", "visa cash app rb", "rb f1 team",
        "racing bulls", "rb",
    ),
    "cadillac": ("cadillac",),
}
MIN_FRAGMENT = 4

# --- display (fixed values) --------------------------------------------------
DISPLAY_NAMES = {"red_bull": "Red Bull", "mclaren": "McLaren", "aston_martin": "Aston Martin",
                 "racing_bulls": "Racing Bulls", "sauber": "Audi"}
RESULT_CODES = {"R": "DNF", "D": "DSQ", "W": "DNS", "N": "NC", "E": "EXC", "F": "DNQ"}

# --- grid statuses (fixed values) --------------------------------------------
CONFIRMED, PROVISIONAL, ASSUMED, UNAVAILABLE = "confirmed", "provisional", "assumed", "unavailable"

# --- observation rules (fixed values) ----------------------------------------
MIN_RUN_LAPS = 4
SESSION_PREFERENCE = ("FP2", "FP3", "FP1")

# --- statistics (fixed values) -----------------------------------------------
SEED = 20260911
BOOTSTRAP_REPLICATES = 10_000
CONFIDENCE = 0.95
PL_DRAWS = 20_000
TEMPERATURE_LOW, TEMPERATURE_HIGH, TEMPERATURE_STEPS = 0.05, 20.0, 60
WEIGHT_GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
ALPHA_GRID = tuple(round(i / 10, 1) for i in range(11))
PROBABILITY_FLOOR = 1e-15
LOG_ODDS_CLIP = 1e-6
COHERENCE_TOLERANCE = 0.02

# --- promotion gates (fixed values) ------------------------------------------
MIN_WINNER_GAIN = 0.05
MIN_PODIUM_GAIN = 0.03
MAX_TOP10_LOSS = 0.02
MAX_SPEARMAN_LOSS = 0.02
MAX_PODIUM_BRIER_LOSS = 0.01
MIN_FOLDS = 3
MIN_CONTESTS = 60

POINTS = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)

STATUS_MAP = {word: category for category, words in STATUS_WORDS.items() for word in words}
NAME_MAP = {word: name for name, words in NAME_WORDS.items() for word in words}

# Names of the compared orderings in recorded tables.
ORDERING_NAMES = ("grid_baseline", "top10_classifier", "rank_model", "blend")
