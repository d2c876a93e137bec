"""Fixed values.

Everything here must equal the values stored by the exchanges or written by
earlier loads, otherwise results change. They are plain constants, not logic.
"""

# Platform names as stored in the `platform` column. The first trades outcome
# tokens grouped by condition, the second trades one ticker per market.
TOKEN_PLATFORM = "polymarket"
TICKER_PLATFORM = "kalshi"
PLATFORMS = (TOKEN_PLATFORM, TICKER_PLATFORM)

# Series names as stored in the `series` column.
TOKEN_SERIES = "league-of-legends"
MAP_WINNER_SERIES = "KXLOLMAP"

# Status and result words.
TOKEN_OPEN_STATUSES = ("open",)
TOKEN_TERMINAL_STATUSES = ("closed",)
TICKER_OPEN_STATUSES = ("open", "active")
TICKER_SETTLED_STATUSES = ("settled", "finalized")
OPEN_STATUSES = ("open", "active")
BINARY_RESULTS = ("yes", "no")
YES_NO_OUTCOMES = ("Yes", "No")

# Watch window around a game start, seconds.
WATCH_BEFORE = 45 * 60
WATCH_AFTER = 8 * 3600

# Draft study, seconds.
PRE_DRAFT = 16 * 60
POST_DRAFT = 2 * 60
MATCH_WINDOW = 12 * 3600
GAME_SPACING = 70 * 60

# Draft model.
MIN_INTERACTION_N = 25
RIDGE_LAMBDA = 1000.0
MIN_TRAINING_ROWS = 100
P_CLAMP = 0.02
PRE_CLAMP = 0.01
MIN_SPLIT_ROWS = 50

# Calibration.
HORIZON_MIN = -2 * 3600
HORIZON_MAX = 30 * 86400
BINS_MIN, BINS_MAX, BINS_DEFAULT = 2, 100, 100
RESOLVED_YES, RESOLVED_NO = 0.99, 0.01

# History windows, seconds unless named otherwise.
LONG_LIVED = 21 * 86400
LEAD_IN = 7 * 86400
TRADE_TAIL = 86400
FINE_BEFORE = 3600
LATE_FINE = 3 * 86400
TOKEN_CHUNK = {1: 86400, 10: 10 * 86400}
TICKER_CHUNK_PERIODS = 4900
FIRST_MONTH = "2023-01-01"
MONTH_HORIZON_DAYS = 730
TRADE_OVERLAP = 60

# Words that do not tell teams apart.
TEAM_SUFFIXES = ("esports", "esport", "e-sports", "gaming", "team", "club", "gg")

# Month codes inside tickers.
MONTH_CODES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN",
               "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
TICKER_ZONE = "America/New_York"
