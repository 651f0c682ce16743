"""Limits, states and names that results depend on."""

from datetime import datetime

# Byte limits of the message client, and the largest accepted per topic.
CLIENT_MAX_BYTES = 15048576
TOPIC_MAX_BYTES = 20000000
MONITOR_MAX_BYTES = 200000
CONSUMER_TIMEOUT_MS = 1800000

# Topic used for replayed documents when none is named, and the topic whose
# group listens when none is named.
DEFAULT_REPLAY_TOPIC = "docking_experiments"
DEFAULT_LISTENER = "monitor"

# Step states that fail a job, that finish it, and that keep it active.
STEP_FAILED = ["CANCELLED", "FAILED", "CANCEL_PENDING", "INTERRUPTED"]
STEP_COMPLETED = "COMPLETED"
STEP_ACTIVE = ["PENDING", "RUNNING"]

# Cluster states from which a job may be submitted, every listed state, and
# the date after which clusters are looked at.
CLUSTER_READY = ["RUNNING", "WAITING"]
CLUSTER_STATES = [
    "STARTING", "BOOTSTRAPPING", "RUNNING", "WAITING",
    "TERMINATING", "TERMINATED", "TERMINATED_WITH_ERRORS",
]
CLUSTERS_SINCE = datetime(2021, 6, 1)

# Master that local steps are submitted to.
LOCAL_MASTER = "spark://127.0.0.1:7077"

# Replicas that are enough to call a still growing set ready.
ENOUGH_REPLICAS = 20

# Waits: readiness (timeout, interval), step polls, action polls, file polls.
READY_TIMEOUT = 400
READY_INTERVAL = 5
STEP_MAX_POLLS = 50
ACTION_MAX_POLLS = 10
FILE_MAX_POLLS = 50

# Rows returned by a limited scan.
SCAN_LIMIT = 50

# Names left out when a directory tree is copied.
IGNORED_DIRS = [
    ".git", ".DS_Store", "__pycache__", ".idea", "target", "dist", "build",
    "BEAUTY", "COMPACT", "sync_conf", "plan", "egg-info", "python-driver",
    "Downloads", "unique_conf",
]
IGNORED_FILES = [".iml", ".egg", ".DS_Store", ".log", ".pyc", ".egg-info"]

# Environments whose artifacts stay on the local machine.
LOCAL_ENVS = ["mac", "ubuntu", "exdocker", "docker", "kind", "minikube", "local"]
