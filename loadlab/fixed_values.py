"""Fixed values.

Everything here has to be exactly so for results to agree with slow logs,
request tables and report files that already exist: patterns, markers, header
names and units.  Nothing in this file is tunable.
"""

# Slow-log line, in three parts that follow each other with anything between.
# Capture groups in order: ts, log_type, host, index | types | search_type, source.
# "(?d)" lets "." stop at "\n" only.
SLOWLOG_HEAD = r"\[([^\]]+)\].?\[.*\].?\[([^\]]+)\].?\[(.*)\].?\[([^\]]+)\].?\[.*\]"
SLOWLOG_MIDDLE = r"types\[(.*)\].*stats"
SLOWLOG_TAIL = r"search_type\[([^\]]+)\].*source\[(.*)\], extra_source"
SLOWLOG_LINE = SLOWLOG_HEAD + ".*" + SLOWLOG_MIDDLE + ".*" + SLOWLOG_TAIL
UNIX_LINES = "(?d)"

# The only kind of slow-log entry that can be replayed.
QUERY_LOG_TYPE = "index.search.slowlog.query"

# Log time: date, space, time, optional fraction after "." or ",".
LOG_TIME = r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}(\.\d+)?$"

# Placeholder for a dictionary term in a query template.
TERM_PLACEHOLDER = "$RDICT"

# Between field name and pattern in an anonymisation option.
FIELD_PATTERN_SEPARATOR = "::"

# Nanoseconds per second; loadspec delays are in nanoseconds.
NANOS = 1_000_000_000

# Report quantiles and report headers.
QUANTILES = (0.5, 0.9, 0.99, 0.999)
QUANTILE_NAMES = ("p50", "p90", "p99", "p999")
HISTOGRAM_HEADER = ("ts", "count", "p50", "p90", "p99", "p999")
REQUEST_HEADER = ("ts", "code", "took_in_millis", "latency_micros", "id")
QUANTILE_FORMAT = "%.2f"
DEFAULT_INTERVAL_SECONDS = 5

# Names of the report files that are not node metric series.
RESPONSE_TIME = "response.time"
PAUSE_TIME = "pause.time"
REQUESTS_SENT = "requests.sent"
ERRORS = "errors"
REQUEST = "request"

# Node metric series: name, two column names, two paths below nodes.<id>.
NODE_SERIES = {
    "mem.young": (("used", "max"), ("jvm.mem.pools.young.used_in_bytes", "jvm.mem.pools.young.max_in_bytes")),
    "mem.tenured": (("used", "max"), ("jvm.mem.pools.old.used_in_bytes", "jvm.mem.pools.old.max_in_bytes")),
    "mem.survivor": (("used", "max"), ("jvm.mem.pools.survivor.used_in_bytes", "jvm.mem.pools.survivor.max_in_bytes")),
    "mem.heap": (("used", "commited"), ("jvm.mem.heap_used_in_bytes", "jvm.mem.heap_committed_in_bytes")),
    "mem.nonheap": (("used", "commited"), ("jvm.mem.non_heap_used_in_bytes", "jvm.mem.non_heap_committed_in_bytes")),
    "mem.os": (("used", "total"), ("os.mem.used_in_bytes", "os.mem.total_in_bytes")),
    "mem.swap": (("used", "total"), ("os.swap.used_in_bytes", "os.swap.total_in_bytes")),
    "cpu": (("percent", "time"), ("process.cpu.percent", "process.cpu.total_in_millis")),
    "gc.young": (("count", "time"), ("jvm.gc.collectors.young.collection_count", "jvm.gc.collectors.young.collection_time_in_millis")),
    "gc.full": (("count", "time"), ("jvm.gc.collectors.old.collection_count", "jvm.gc.collectors.old.collection_time_in_millis")),
}
