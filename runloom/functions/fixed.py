"""Results depend on these being exactly as they are."""

# States of runs and tasks.
PENDING = "pending"
RUNNING = "running"
SUCCESS = "success"
FAILED = "failed"
UPSTREAM_FAILED = "upstream_failed"
TERMINAL = (SUCCESS, FAILED, UPSTREAM_FAILED)
TRIGGERS = ("manual", "schedule", "gitops", "api")

# Schedule words (seconds; no interval for a one-off) and units.
SCHEDULE_SECONDS = {"@hourly": 3600.0, "@daily": 86400.0, "@weekly": 604800.0}
SCHEDULE_ONCE = "@once"
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

# Texts that mean "not given".
BLANKS = ("", "string", "null", "none")

# Parts of a message that mark a failed login.
AUTH_NEEDLES = (
    "could not read username",
    "authentication failed",
    "permission denied",
    "terminal prompts disabled",
    "repository not found",
)

# Messages, formats and limits.
NO_RESULT = "%s executor: process exited %s without writing a result"
UNKNOWN_ERROR = "unknown error"
REAPED = "abandoned: the scheduler running this task died"
UPSTREAM = "upstream '%s' failed"
NO_MODEL = "no registered model '%s'"
NO_VERSION = "no version '%s' of model '%s'"
NO_ROWS = "nothing to predict"
NOT_A_NUMBER = "not a number in '%s'"
NO_LOGS = "no logs for task '%s' in %s"
WIDTH = "expected %d values (%s), got %d"
BELOW_GATE = "accuracy %.4f below threshold %s — refusing to register"
RUN_KEY_TIME = "yyyyMMdd'T'HHmmss"
LOG_TAIL_CHARS = 2000
REAP_AFTER_SECONDS = 900
RECENT_RUNS = 20
MIN_ACCURACY = 0.90
TEST_SHARE = "0.25"
DEFAULT_EXPERIMENT = "inference"
CANDIDATE_PREFIX = "train_"
EXAMPLE_ROWS = 3
DEFAULT_KIND = "PipelineModel"  # of a version without a kind tag
