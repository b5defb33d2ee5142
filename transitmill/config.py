"""Values that define the semantics of the operators."""

# fixed values of the data feed and of the published definitions
TIME_ZONE = "Europe/Brussels"
TICK_S = 20
FIRST_HOUR = 4
GRID_HOURS = (4, 28)
BANDS = {"day": (6, 21), "eve": (20, 24), "am": (7, 10), "pm": (16, 19)}
LONG_BANDS = ("day", "eve")
STAND_MOVE_M, STAND_GAP_S, STAND_LONG_S = 8.0, 90, 180
MIN_COVERAGE, MAX_BAD_SHARE = 0.8, 0.25
NO_POLL, FROZEN, LINE_ABSENT, PARTIAL_FEED = 1, 2, 4, 256
FEED_BAD = NO_POLL | FROZEN
PRESENT_ROWS = 20
MIN_FEED_SHARE = 0.6
REGULATION_SHARE = 0.5
MIN_DAYS = 5
NO_FEED_SHARE, STRIKE_SHARE = 0.5, 0.75
REF_QUANTILE, REF_DAYS, MIN_SIDE = 0.9, 90, 5
HOLIDAY_RATIO, REDUCED_RATIO, RUN_DAYS, RUN_DROP, GUARD_SHARE = 0.94, 0.75, 5, 0.85, 0.6
BREAK_S, BUNCH, GAP, STOP_SHARE = 3600, 0.5, 1.5, 0.8
APPROACH_M, DEFAULT_HEAD_M = 36, 39
MARK_RANGE, MARK_MIN, MARK_SHARE = (10, 60), 20, 0.1
OVERLAP_M, OVERLAP_SHARE, DENSIFY_M = 30.0, 0.8, 5.0
DEGREE_M = (111320.0, 110540.0)
DETOUR_M, DETOUR_SHARE, DETOUR_TOTAL, DETOUR_RUN_M = 150.0, 0.2, 0.05, 30.0
LOOK_BACK_DAYS, LASTING_DAYS = 365, 7
PAD_DAYS = 104
SPAN_LIMIT_DAYS = 400
MAP_MIN_PER_DAY, MAP_MAX_KMH = 1.0, 70.0
EARTH_KM = 6371.0088
MIN_STOP_DAYS = 0.5
MIN_FIXES, SPARSE_SHARE = 5, 0.1
