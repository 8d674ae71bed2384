"""Fixed values.

Word lists, thresholds and labels in this module are part of the output
contract: results are only comparable when they are exactly these values.
"""

# --- field aliases (first present, non-null key wins) -------------------------
ALIASES = {
    "source": ["source", "log_source", "origin", "facility"],
    "host": ["host", "hostname", "host_name", "computer_name"],
    "event_type": ["event_type", "type", "event", "action", "category"],
    "message": ["message", "msg", "log", "text", "description"],
    "severity": ["severity", "level", "priority"],
    "timestamp": ["timestamp", "time", "@timestamp", "event_time", "datetime"],
    "source_ip": ["source_ip", "ip", "src_ip", "client_ip", "remote_addr"],
    "user": ["user", "username", "account", "user_name"],
}

# --- severities ---------------------------------------------------------------
LOG_SEVERITIES = ["low", "medium", "high", "critical"]
ALERT_SEVERITIES = ["informational", "low", "medium", "high", "critical"]
PRIORITY_BY_SEVERITY = {
    "critical": "P1",
    "high": "P2",
    "medium": "P3",
    "low": "P4",
    "informational": "P5",
}
HIGH_EVENT_TYPES = ["auth.failure", "privilege.escalation", "malware.detected", "intrusion.detected"]
MEDIUM_EVENT_TYPES = ["port.scan", "http.suspicious", "api.abuse", "container.anomaly"]
MAX_PAYLOAD_BYTES = 102400

# --- web attack indicators ----------------------------------------------------
SQL_INJECTION_PATTERNS = [
    r"union[\s\+]+select",
    r"select[\s\+]+.+\bfrom\b",
    r"insert[\s\+]+into",
    r"drop[\s\+]+table",
    r"or[\s\+]+'?1'?[\s]*=[\s]*'?1'?",
    r"'[\s]*or[\s]*'",
    r"--[\s]",
    r";[\s]*drop",
    r"xp_cmdshell",
    r"waitfor[\s]+delay",
    r"benchmark\(",
    r"sleep\(",
    r"char\(",
    r"exec\(",
]
PATH_TRAVERSAL_PATTERNS = [
    r"\.\./",
    r"\.\.\\",
    r"%2e%2e%2f",
    r"%252e%252e",
    r"etc/passwd",
    r"etc/shadow",
    r"windows/system32",
    r"win\.ini",
    r"boot\.ini",
]
RECON_PATHS = [
    "/.git",
    "/.env",
    "/.htaccess",
    "/admin",
    "/config",
    "/backup",
    "/phpinfo",
    "/wp-admin",
    "/wp-config",
    "/server-status",
    "/actuator",
    "/debug",
    "/.ds_store",
    "/web.config",
    "/credentials",
    "/phpmyadmin",
    "/manager",
    "/console",
    "/api/v1/admin",
]
SCANNER_AGENTS = [
    "sqlmap",
    "nikto",
    "nmap",
    "masscan",
    "hydra",
    "metasploit",
    "burpsuite",
    "dirbuster",
    "gobuster",
    "wfuzz",
    "acunetix",
    "nessus",
    "openvas",
    "zap",
    "w3af",
]
# the detection step spells one agent differently from the rule step
DETECTION_SCANNER_AGENTS = [
    "sqlmap",
    "nikto",
    "nmap",
    "masscan",
    "hydra",
    "metasploit",
    "burpsuite",
    "dirbuster",
    "gobuster",
    "wfuzz",
    "acunetix",
    "nessus",
    "openvas",
    " zap/",
    "w3af",
]
LOGIN_URI_PARTS = ["/login", "/signin", "/auth", "/session", "/token", "/api/auth", "/api/login"]
RECON_STATUS_CODES = ["401", "403", "404", "500"]
BLACKLISTED_IPS = ["192.168.1.10", "10.0.0.99", "203.0.113.50"]

# --- rules ----------------------------------------------------------------------
# (rule_name, rule_code, rule_type, severity, source_type, event_type_pattern,
#  message_pattern, threshold_count, threshold_minutes, risk_score)
DEFAULT_RULES = [
    ("SQL Injection Attempt", "SQL_INJECTION", "pattern", "critical", "web", None,
     "/(union|select|insert|update|delete|drop|alter).*from/i", None, None, 90),
    ("Malicious Binary Downloaded", "MALICIOUS_DOWNLOAD", "pattern", "high", "chrome", None,
     "/(\\.exe|\\.dll|\\.bat|\\.sh|\\.ps1) downloaded from untrusted/i", None, None, 80),
    ("Suspicious Process Spawned", "SUSPICIOUS_PROCESS", "pattern", "high", "windows", None,
     "/whoami|net user|ipconfig|powershell -enc/i", None, None, 85),
    ("Docker Container Command Execution", "SUSPICIOUS_DOCKER_EXEC", "pattern", "critical", "docker", None,
     "/docker exec.*(sh|bash|nc|curl|wget)/i", None, None, 95),
    ("Multiple Failed Login Attempts", "FAILED_LOGIN_BURST", "threshold", "high", "auth", "login.failure",
     None, 3, 5, 75),
    ("Reconnaissance Port Scan", "PORT_SCAN", "threshold", "medium", "firewall", "connection.rejected",
     None, 5, 2, 50),
]
# (rule_code, rule_name, severity, risk_score, metadata field, operator, values)
WEB_RULES = [
    ("NGINX_AUTH_FAILURE", "NGINX Authentication Failure", "high", 60, "status_code", "eq", ["401"]),
    ("NGINX_SQL_INJECTION", "NGINX SQL Injection Attempt", "critical", 90,
     "request_uri", "regex_any", SQL_INJECTION_PATTERNS),
    ("NGINX_PATH_TRAVERSAL", "NGINX Path Traversal Attempt", "high", 80,
     "request_uri", "regex_any", PATH_TRAVERSAL_PATTERNS),
    ("NGINX_RECON_SCAN", "NGINX Reconnaissance Path Scan", "medium", 50,
     "request_uri", "startswith_any", RECON_PATHS),
    ("NGINX_SUSPICIOUS_UA", "NGINX Suspicious User-Agent (Scanner/Attack Tool)", "high", 70,
     "user_agent", "contains_any", SCANNER_AGENTS),
]
WEB_RULE_SOURCE = "nginx"

# --- classification word lists ------------------------------------------------
AUTH_KEYWORDS = [
    "failed login", "login failed", "authentication failed", "password mismatch",
    "successful login", "login successful", "session opened", "session closed",
    "su attempt", "bad su", "access denied", "access granted", "unauthorized",
]
DB_KEYWORDS = [
    "postgres", "postgresql", "mysql", "sqlite", "oracle", "mongodb",
    "mssql", "sqlserver", "db2", "redis", "cassandra",
]
SQL_COMMANDS = [
    "select ", "insert ", "update ", "delete ", "create table", "drop table",
    "alter table", "create index", "grant ", "revoke ",
]
FIREWALL_SOURCES = ["firewall", "fw", "paloalto", "cisco-asa", "fortigate", "iptables"]
FIREWALL_KEYS = ["srcip", "dstip", "action", "proto", "sport", "dport", "dst", "src"]
WINDOWS_SUBTYPES = {
    "authentication": [4624, 4625],
    "process_creation": [4688],
    "account_management": [4720, 4722, 4723, 4724, 4725, 4726, 4738, 4740],
    "service_installation": [7045, 4697],
    "object_access": [4663, 4656],
    "audit_log": [1102, 4719],
}

# --- line layouts: which lines count as a format, and which of their parts is which, must be exactly this ----
SYSLOG_3164 = (
    r'^<(?P<pri>\d+)>(?P<timestamp>[A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+'
    r'(?P<host>[^\s]+)\s+(?P<tag>[a-zA-Z0-9_\-\/]+)(?:\[(?P<pid>\d+)\])?:\s*(?P<message>.*)$'
)
SYSLOG_5424 = (
    r'^<(?P<pri>\d+)>1\s+(?P<timestamp>[^\s]+)\s+(?P<host>[^\s]+)\s+(?P<app_name>[^\s]+)\s+'
    r'(?P<procid>[^\s]+)\s+(?P<msgid>[^\s]+)\s+(?P<structured_data>\[.*\]|-)\s*(?P<message>.*)$'
)
WEB_LOG = (
    r'^(?P<ip>[^\s]+)\s+(?P<ident>[^\s]+)\s+(?P<authuser>[^\s]+)\s+\[(?P<timestamp>[^\]]+)\]\s+'
    r'"(?P<method>[A-Z]+)\s+(?P<request>[^\s"]*)\s*(?P<protocol>[^"]*)?"'
    r'\s+(?P<status>\d+)\s+(?P<bytes>[^\s]+)'
    r'(?:\s+"(?P<referrer>[^\"]*)"\s+"(?P<user_agent>[^\"]*)")?$'
)
# the next two in any case of letters
CEF = (
    r'^CEF:(?P<cef_version>\d+)\|(?P<vendor>[^|]*)\|(?P<product>[^|]*)\|'
    r'(?P<dev_version>[^|]*)\|(?P<event_id>[^|]*)\|(?P<name>[^|]*)\|'
    r'(?P<severity>[^|]*)\|?(?P<extensions>.*)$'
)
LEEF = (
    r'^LEEF:(?P<leef_version>[^|]*)\|(?P<vendor>[^|]*)\|(?P<product>[^|]*)\|'
    r'(?P<dev_version>[^|]*)\|(?P<event_id>[^|]*)\|?(?P<attributes>.*)$'
)
ACCESS_LOG_COMBINED = (
    r'^(?P<remote_addr>\S+)\s+'
    r'(?P<remote_user>\S+)\s+'
    r'(?P<auth_user>\S+)\s+'
    r'\[(?P<time_local>[^\]]+)\]\s+'
    r'"(?P<request>[^"]*?)"\s+'
    r'(?P<status>\d{3})\s+'
    r'(?P<body_bytes_sent>\d+|-)\s+'
    r'"(?P<http_referer>[^"]*?)"\s+'
    r'"(?P<http_user_agent>[^"]*?)"'
    r'.*$'
)
ACCESS_LOG_EXTENDED = (
    r'^(?P<remote_addr>\S+)\s+'
    r'(?P<remote_user>\S+)\s+'
    r'(?P<auth_user>\S+)\s+'
    r'\[(?P<time_local>[^\]]+)\]\s+'
    r'"(?P<request>[^"]*?)"\s+'
    r'(?P<status>\d{3})\s+'
    r'(?P<body_bytes_sent>\d+|-)\s+'
    r'"(?P<http_referer>[^"]*?)"\s+'
    r'"(?P<http_user_agent>[^"]*?)"\s+'
    r'"(?P<http_host>[^"]*?)"\s+'
    r'"(?P<upstream_addr>[^"]*?)"\s+'
    r'"(?P<request_time>[^"]*?)"'
    r'(?:\s+"(?P<request_id>[^"]*?)")?'
    r'.*$'
)
ERROR_LOG = (
    r'^(?P<time>\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+'
    r'\[(?P<level>\w+)\]\s+'
    r'(?P<pid>\d+)#(?P<tid>\d+):\s+'
    r'(?:\*(?P<cid>\d+)\s+)?'
    r'(?P<message>.+)$'
)
UPSTREAM_PORT = r':(\d+)(?:/|$)'

# --- key=value lines: a line counts only when it names one of these -------------
KNOWN_PAIR_KEYS = [
    "src", "dst", "action", "user", "host", "event", "type",
    "severity", "level", "proto", "dport", "sport", "msg",
    "reason", "ip", "timestamp", "srcip", "dstip", "username",
    "device", "facility", "alert", "category",
]
CSV_REJECTED_PREFIXES = ["The ", "A ", "An ", "This ", "Error ", "Warning "]

# --- correlation: suppression minutes per type ----------------------------------
SUPPRESSION_MINUTES = {
    "failed_login_burst": 5,
    "brute_force_success": 10,
    "multi_host_attack": 15,
    "reconnaissance_activity": 10,
    "high_risk_rule_chain": 15,
    "browser_download_execution_chain": 30,
    "docker_attack_pattern": 10,
    "risk_score_escalation": 60,
    "nginx_brute_force": 5,
    "nginx_recon_scanning": 10,
}

# --- state machines ---------------------------------------------------------------
INCIDENT_TRANSITIONS = {
    "open": ["acknowledged"],
    "acknowledged": ["investigating"],
    "investigating": ["closed"],
    "closed": [],
}
NOTIFICATION_TRANSITIONS = {
    "pending": ["sent", "delivered", "failed", "suppressed"],
    "sent": ["delivered", "failed"],
    "delivered": ["acknowledged", "escalated", "suppressed"],
    "failed": ["pending", "sent"],
    "suppressed": ["pending", "closed", "escalated", "acknowledged"],
    "acknowledged": ["investigating", "closed"],
    "investigating": ["resolved", "closed"],
    "resolved": ["closed"],
    "escalated": ["acknowledged", "investigating", "closed", "escalated", "delivered"],
    "closed": [],
}
STOPPING_ALERT_STATUSES = ["acknowledged", "resolved", "closed", "false_positive"]
CHANNELS = ["Email", "Teams", "Slack", "Webhook", "PagerDuty"]
# (policy_name, severity, initial_role, escalation_role, escalation_minutes,
#  second_escalation_role, second_escalation_minutes)
DEFAULT_POLICIES = [
    ("Low Severity Policy", "low", "analyst", "lead_analyst", 30, "soc_manager", 60),
    ("Medium Severity Policy", "medium", "analyst", "lead_analyst", 15, "soc_manager", 30),
    ("High Severity Policy", "high", "lead_analyst", "soc_manager", 10, None, None),
    ("Critical Severity Policy", "critical", "lead_analyst", "soc_manager", 5, None, None),
]

# --- browser history ----------------------------------------------------------------
TRANSITION_NAMES = [
    "Link", "Typed", "Auto_Bookmark", "Auto_Subframe", "Manual_Subframe", "Generated",
    "Auto_Toplevel", "Form_Submit", "Reload", "Keyword", "Keyword_Generated",
]
WEBKIT_EPOCH_OFFSET_US = 11_644_473_600_000_000

# --- container lifecycle --------------------------------------------------------------
CONTAINER_EVENT_TYPES = {
    "start": "docker.container_started",
    "stop": "docker.container_stopped",
    "die": "docker.container_stopped",
    "restart": "docker.container_restarted",
    "oom": "docker.container_stopped",
    "exec_create": "docker.security_event",
    "exec_start": "docker.security_event",
}

# --- applications behind the web server --------------------------------------------------
DEFAULT_APPLICATIONS = [
    ("LoginApp", "8080", "localhost"),
    ("LoginApp2", "8081", "localhost"),
    ("LoginApp3", "8082", "localhost"),
]

# --- ports ------------------------------------------------------------------------------------
SERVICE_NAMES = {
    8080: "Academia",
    8081: "Besto Health",
    8082: "Besto Clinic",
    80: "HTTP Web Server",
    443: "HTTPS Web Server",
    22: "SSH Service",
    3306: "MySQL Database",
    5432: "PostgreSQL Database",
    8000: "SOC Backend API",
}
DEFAULT_PORTS = [8080, 8081, 8082, 443, 80, 22, 3306, 5432, 8000]
# IANA special-purpose IPv4 blocks that count as private, and the carve-outs
PRIVATE_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
PRIVATE_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
