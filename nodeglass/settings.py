"""Fixed values shared by every operator.

They define what the reports mean (window length, label codes, risk limits,
model parameters), so they are kept in one place and passed as defaults.
"""

# Log-count window and the load columns that rotate with it.
WINDOW = 5000
LOAD_FILL = 0.3

# Status labels by HTTP code.
HEALTHY_CODE = 200
PARTIAL_CODE = 206
THROTTLED_CODE = 429
SERVER_ERROR_FROM = 500

# Risk limits as (level, average latency above, hits at least).
RISK_LIMITS = [("CRITICAL", 200, 10), ("HIGH", 150, 5), ("MEDIUM", 120, 2)]
RISK_QUOTAS = {"CRITICAL": 15, "MEDIUM": 5, "LOW": 5}

# Detection models.
DETECTOR = "IsolationForest"
ANOMALY_THRESHOLD = 0.0
FOREST_TREES = 200
FOREST_SUBSAMPLE = 256
CONTAMINATION = 0.08
SEED = 42
BOOST_ROUNDS = 300
BOOST_DEPTH = 5
BOOST_RATE = 0.05

# Texts shown by reports and replies.
LOG_MESSAGE = "Forensic Packet Recv: %d | RT=%dms"
ROTATION_TIMER = "-%04d_PKTS"
SYNC_SUFFIX = "_LOCKED"
DASHBOARD_STATUS = "OPERATIONAL_SYNCED_STRATIFIED"
CLAIMED_STATUS = "OPERATIONAL"
UNKNOWN_SERIAL = "UNKNOWN"
INGESTED_MESSAGE = "Successfully ingested %d logs."
NOTHING_INGESTED_MESSAGE = "No valid nodes in batch."

# Physical layout: one partition folder of the log table spans this many ids.
# It is a multiple of WINDOW, so a count window touches at most two folders,
# and large enough that a folder holds files of a sensible size.
IDS_PER_FOLDER = 50_000_000
