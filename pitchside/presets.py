"""Soccer configuration: weights, maps, coordinates, crop specs, measures.

Everything in this module is a FIXED VALUE that must equal the reference's
configuration for results to agree. The values are stated as plain text, in
their natural order, and are only data; the logic that uses them lives in
``pitchside.operators``.
"""

from __future__ import annotations

# --- fixed values: player scoring -------------------------------------------
# aspect -> {metric: weight}; aspect order is defensive, attacking, passing.
ASPECTS = ["defensive", "attacking", "passing"]

WEIGHTS = {
    "defensive": {
        "aerial_duels_won": 1.2,
        "interceptions": 1.8,
        "recoveries": 1.5,
        "defensive_duels_won": 2.0,
        "clearances": 1.8,
    },
    "attacking": {
        "goals": 2.0,
        "assists": 1.8,
        "xg": 1.5,
        "successful_dribbles": 1.2,
        "xa": 1.2,
    },
    "passing": {
        "passes_into_final_third": 2.0,
        "passes_into_box": 1.8,
        "forward_passes": 1.5,
        "crosses": 1.5,
    },
}

MINUTES_COL = "Minutes played"
POSITION_COL = "Position"
POSITION_SEP = ", "
POSITION_UNKNOWN = "0"

# --- fixed values: canonical position -> raw position codes -----------------
POSITION_GROUPS = {
    "AMF": ["AMF", "LAMF", "RAMF"],
    "CF": ["CF"],
    "GK": ["GK"],
    "CB": ["CB", "LCB", "LCBB", "RCB", "RCBB", "LCB3", "RCB3"],
    "DMF": ["DMF", "LDMF", "RDMF"],
    "LB": ["LB", "LB5"],
    "RB": ["RB", "RB5"],
    "LW": ["LW", "LWB", "LWF"],
    "RW": ["RW", "RWB", "RWF"],
    "LCM": ["LCM", "LCMF3", "LCMF"],
    "RCM": ["RCM", "RCMF3", "RCMF"],
}

# --- fixed values: counter position and counter aspect ----------------------
COUNTER_POSITION = {
    "AMF": "DMF",
    "CF": "CB",
    "GK": "GK",
    "CB": "CF",
    "DMF": "AMF",
    "LB": "RW",
    "RW": "LB",
    "RB": "LW",
    "LW": "RB",
    "LCM": "RCM",
    "RCM": "LCM",
}

COUNTER_ASPECT = {
    "defensive": "attacking",
    "attacking": "defensive",
    "passing": "passing",
}

# --- fixed values: pitch coordinates of a canonical position ----------------
PITCH_COORDS = {
    "GK": (40, 0),
    "CB": (40, 25),
    "LB": (10, 20),
    "RB": (70, 20),
    "DMF": (40, 50),
    "AMF": (40, 70),
    "CF": (40, 100),
    "LW": (10, 90),
    "RW": (70, 90),
    "LCM": (10, 60),
    "RCM": (70, 60),
}
RIVAL_OFFSET_Y = 5

# --- fixed values: team-season summary --------------------------------------
# measure -> "sum" | "mean", in the reference's column order.
TEAM_MEASURES = {
    "goals": "sum",
    "xg": "mean",
    "shots": "sum",
    "sot": "sum",
    "pass_success_rate": "mean",
    "possession": "mean",
    "losses": "sum",
    "recoveries": "sum",
    "tot_duels": "sum",
    "tot_duels_won": "sum",
    "tot_duels_win_rate": "mean",
    "corners": "sum",
    "fouls": "sum",
    "yellows": "sum",
    "reds": "sum",
    "shots_against": "sum",
    "goals_against": "sum",
    "def_duels": "sum",
    "interceptions": "sum",
    "clearences": "sum",
    "offsides": "sum",
}
DEFAULT_SEASON = 2024

# --- fixed values: prompt text ----------------------------------------------
# (label, summary column, suffix) of the team stat lines, in order.
PROMPT_STAT_LINES = [
    ("Team", "team", ""),
    ("Goals", "goals", ""),
    ("Expected Goals (xG)", "xg", ""),
    ("Shots", "shots", ""),
    ("Shots on Target (SOT)", "sot", ""),
    ("Pass Success Rate", "pass_success_rate", "%"),
    ("Possession", "possession", "%"),
    ("Losses", "losses", ""),
    ("Recoveries", "recoveries", ""),
    ("Total Duels", "tot_duels", ""),
    ("Corners", "corners", ""),
    ("Fouls", "fouls", ""),
    ("Yellow Cards", "yellows", ""),
    ("Red Cards", "reds", ""),
    ("Shots Against", "shots_against", ""),
    ("Goals Against", "goals_against", ""),
    ("Defensive Duels", "def_duels", ""),
    ("Interceptions", "interceptions", ""),
    ("Clearances", "clearences", ""),
    ("Offsides", "offsides", ""),
]
PROMPT_LANE_LINES = [("Left Side", "left"), ("Middle", "mid"), ("Right Side", "right")]
PROMPT_INTRO = ("Analyze the strengths and weaknesses of the opposing team based on "
                "the following statistics:")
PROMPT_OUTRO = "Provide insights on the team's weaknesses and strategies for exploiting them."
SYSTEM_MESSAGE = "You are a soccer head coach."

# --- fixed values: OCR lane tokens ------------------------------------------
XG_PATTERN = r"/\s*([<]?\d*\.?\d+)\s*XG"
LANES = ["left", "mid", "right"]

# --- fixed values: formation table ------------------------------------------
FORMATION_COLUMNS = ["Total", "1st half", "2nd half"]
FORMATION_INTERVALS = ["1-15", "16-30", "31-45+", "46-60", "61-75", "76-90+"]

# --- fixed values: image grid ------------------------------------------------
GRID_CELL = (10, 10)
GRID_FRACTION = 0.1          # what the driver script passes; the function default is 0.2
GRAY_BAND = (70, 255)        # gray <= 70 or gray >= 255 is "marked"
# 8-bit HSV ranges (inclusive): (h_lo, s_lo, v_lo), (h_hi, s_hi, v_hi)
HSV_RANGES = {
    "black": ((0, 0, 0), (180, 255, 100)),
    "blue": ((0, 50, 150), (130, 255, 255)),
}
FORMATION_TOP_FRACTION = 0.37      # table section: rows [0, int(h*0.37))
FORMATION_BOTTOM_FROM = 0.30       # graph section: rows [int(h*0.30), h)
FORMATION_X_RANGE = (0.1, 0.9)     # graph section: cols [int(w*0.1), int(w*0.9))

# --- fixed values: report crops ----------------------------------------------
DPI = 300
BASE_DPI = 72
BASE_PAGE_COUNT = 24
# team_slot, crop_no, side, kind, page_base, shifts with page count, rectangle
CROP_SPEC = [
    (1, 1, "home_team", "shooting_map", 10, True, (10, 350, 285, 565)),
    (1, 2, "home_team", "shooting_side", 4, False, (445, 600, 577, 707)),
    (1, 3, "opp_team", "shooting_map", 11, True, (10, 350, 285, 565)),
    (1, 4, "opp_team", "shooting_side", 4, False, (308, 600, 441, 707)),
    (2, 1, "home_team", "shooting_map", 11, True, (10, 350, 285, 565)),
    (2, 2, "home_team", "shooting_side", 4, False, (308, 600, 441, 707)),
    (2, 3, "opp_team", "shooting_map", 10, True, (10, 350, 285, 565)),
    (2, 4, "opp_team", "shooting_side", 4, False, (445, 600, 577, 707)),
]
# the formation cut is taken for either slot
FORMATION_CROP = ("home_team", "avg_formation", 3, False, (5, 570, 200, 755))
OWN_TEAM = "northwestern"
