"""Regular expressions, names and formats that decide the results.

Groups are positional because Java group names allow no underscore; the field names of a pattern
stand next to it in group order.
"""

# --- Fixed values: line formats -----------------------------------------------------------------

APACHE_SHAPE = r'^\d+\.\d+\.\d+\.\d+.*\[.*\].*".*".*\d+.*\d+'

APACHE_COMMON = (
    r'^(\d+\.\d+\.\d+\.\d+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]+)"\s+(\d+)\s+(\d+)'
)
APACHE_COMMON_NAMES = ["clientip", "ident", "auth", "timestamp", "request", "status", "bytes"]

APACHE_ACCESS = (
    r"^(\d{1,3}(?:\.\d{1,3}){3})\s+([^\s]+)\s+([^\s]+)\s+\[([^\]]+)\]\s+"
    r'"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+(\d+|-)'
    r'(?:\s+"([^"]*)"\s+"([^"]*)")?(?:\s+(\d+))?(?:\s+"([^"]*)")?(?:\s+(\d+))?(?:\s+"([^"]*)")?'
)
APACHE_ACCESS_NAMES = [
    "clientip", "ident", "auth", "timestamp", "method", "uri", "protocol", "status", "bytes",
    "referer", "useragent", "req_time", "cookie", "respTime", "version",
]

SYSLOG_STANDARD = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"
SYSLOG_STANDARD_NAMES = ["timestamp", "host", "message"]

SYSLOG_3164 = r"^<(\d+)>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"
SYSLOG_3164_NAMES = ["priority", "timestamp", "host", "message"]

# A trailing Z is accepted besides a numeric offset.
SYSLOG_5424 = (
    r"^<(\d+)>(\d+)\s+(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)\s+"
    r"(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$"
)
SYSLOG_5424_NAMES = [
    "priority", "version", "timestamp", "host", "app_name", "proc_id", "msg_id", "message",
]

# Key-value pairs. The alternatives in place of a back-reference match the same text.
KV_PAIR = r'\w+=(?:"[^"\s]+"|[^"\s]+)'
KV_COLON = r'\w+:\s*(?:"[^"\s]+"|[^"\s]+)'
KV_SPACED = r'\w+\s*=\s*(?:"[^"\s]+"|[^"\s]+)'
KV_QUOTED = r'[a-zA-Z0-9_]+=(?:"[^"]*"|[^\s,]+)'

XML_SIMPLE = r"<(\w+)>([^<]+)</\w+>"
XML_SELF_CLOSING = r"<(\w+)\s+([^>]+)/>"
XML_WITH_ATTRIBUTES = r"<(\w+)\s+([^>]+)>([^<]+)</\w+>"
XML_ATTRIBUTE = r'(\w+)="([^"]+)"'

GENERIC_PATTERNS = {
    "timestamp": r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)",
    "ip_address": r"((?:[0-9]{1,3}\.){3}[0-9]{1,3})",
    "log_level": r"(INFO|WARN|WARNING|ERROR|DEBUG|FATAL|CRITICAL)",
    "email": r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
}

# --- Fixed values: field confidence by extractor ------------------------------------------------

CONFIDENCE = {
    "json": 0.95,
    "apache": 0.95,
    "csv": 0.9,
    "regex_named": 0.9,
    "syslog": 0.85,
    "kv": 0.8,
    "xml": 0.8,
    "kv_in_message": 0.75,
    "regex_numbered": 0.7,
    "regex_match": 0.6,
    "existing": 1.0,
}

# --- Fixed values: types and flags --------------------------------------------------------------

TYPE_PATTERNS = [
    ("timestamp", r"^\d{4}-\d{2}-\d{2}"),
    ("ip", r"^\d+\.\d+\.\d+\.\d+$"),
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("integer", r"^\d+$"),
    ("float", r"^\d+\.\d+$"),
]

# The short forms over-match on purpose: "cc" hits account, "tel" hits hotel.
PII_NAME_PATTERN = (
    r"(?i)email|ssn|social.security|phone|tel|credit.card|cc|password|pwd|user.*name|login"
)
PII_VALUE_PATTERN = (
    r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
    r"|^\d{3}-\d{2}-\d{4}$"
    r"|^\d{3}[-.]?\d{3}[-.]?\d{4}$"
    r"|^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$"
)

# --- Fixed values: time -------------------------------------------------------------------------

TIME_FORMATS_ISO_FIRST = [
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "%Y-%m-%dT%H:%M:%S"),
    (r"\w{3} \d{1,2} \d{2}:\d{2}:\d{2}", "%b %d %H:%M:%S"),
    (r"\d{1,2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}", "%d/%b/%Y:%H:%M:%S"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "%Y-%m-%d %H:%M:%S"),
]

TIME_FORMATS_SLASH_FIRST = [
    (r"(\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2})", "%d/%m/%Y %H:%M:%S"),
    (r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", "%Y-%m-%d %H:%M:%S"),
    (r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", "%Y-%m-%dT%H:%M:%S"),
    (r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})", "%b %d %H:%M:%S"),
    (r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})", "%d/%b/%Y:%H:%M:%S"),
]

# strftime format -> (text to cut out, Java format). Fractions and zones behind an ISO time are read as well;
# such text needs no Java format.
JAVA_TIME_FORMATS = {
    "%Y-%m-%dT%H:%M:%S": (
        r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?", None),
    "%Y-%m-%d %H:%M:%S": (
        r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?", None),
    "%b %d %H:%M:%S": (r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "MMM d HH:mm:ss"),
    "%d/%b/%Y:%H:%M:%S %z": (
        r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}", "dd/MMM/yyyy:HH:mm:ss Z"),
    "%d/%b/%Y:%H:%M:%S": (
        r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?", "dd/MMM/yyyy:HH:mm:ss[ Z]"),
    "%m/%d/%Y %H:%M:%S": (r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}", "MM/dd/yyyy HH:mm:ss"),
    "%d/%m/%Y %H:%M:%S": (r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}", "dd/MM/yyyy HH:mm:ss"),
    "%d-%m-%Y %H:%M:%S": (r"\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2}:\d{2}", "dd-MM-yyyy HH:mm:ss"),
    "%Y%m%d %H:%M:%S": (r"\d{8}\s+\d{2}:\d{2}:\d{2}", "yyyyMMdd HH:mm:ss"),
}
CURRENT_TIME = "CURRENT_TIME"
DEFAULT_LOOKAHEAD = 25
WHOLE_LINE = 2**31 - 1

# --- Fixed values: names given to unnamed groups ------------------------------------------------

COMMON_GROUP_NAMES = [
    "clientip", "ident", "auth", "timestamp", "request", "method", "uri", "protocol", "status",
    "bytes", "referer", "useragent", "req_time", "cookie", "respTime", "version", "host", "port",
    "path", "query", "fragment", "scheme", "user", "password",
]

# --- Fixed values: columns that a search result carries besides its fields ----------------------

SYSTEM_FIELD_PREFIXES = ("_", "date_")
SYSTEM_FIELDS = (
    "punct", "linecount", "timeendpos", "timestartpos", "splunk_server", "splunk_server_group",
)

# --- Fixed values: extraction pattern by field type ---------------------------------------------

IP_VALUE = r"\d{1,3}(?:\.\d{1,3}){3}"
EMAIL_VALUE = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# --- Fixed values: personal data ----------------------------------------------------------------

PII_PATTERNS = {
    "IpAddressDetector": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "EmailDetector": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "CreditCardDetector": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "PhoneDetector": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "en_US.SocialSecurityNumberDetector": r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b",
    "UrlDetector": r"""\bhttps?://[^\s"'<>]+\b""",
}
REDACTION_PATTERNS = {
    **PII_PATTERNS,
    "IpAddressDetector": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}

VALUE_PATTERNS = {
    "EMAIL_ADDRESS": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "IP_ADDRESS": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "PHONE_NUMBER": r"\d{3}[-.]?\d{3}[-.]?\d{4}",
    "CREDIT_CARD": r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}",
    "US_SSN": r"\d{3}[-.]?\d{2}[-.]?\d{4}",
    "DATE_TIME": r"[^\]\s]+",
    "PERSON": r"[A-Za-z\s]+",
    "URL": r"""https?://[^\s"'<>]+""",
}
VALUE_PATTERNS_OF_FIELDS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "ip_address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "phone": r"\d{3}-\d{3}-\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "credit_card": r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}",
    "timestamp": r"[^\]\s]+",
}
DEFAULT_VALUE_PATTERN = r'[^\s,="]+'

# The word class covers the letters and digits of every script, in Java as in RE2.
KV_KEY = r"([\p{L}\p{N}_]+)="
JSON_KEY = r'"([\p{L}\p{N}_]+)"\s*:\s*"'
LEADING_IP = r"^\s*\d+\.\d+\.\d+\.\d+"
CONTEXT_CHARS = 50
POSITIONAL_START = 20

PII_TYPE_ALLOWLIST = [
    "EMAIL", "IP_ADDRESS", "IPADDRESSDETECTOR", "US_BANK_NUMBER", "CREDIT_CARD", "CREDITCARD",
    "PHONE_NUMBER", "PHONEDETECTOR", "SSN", "PASSPORT", "PERSON", "ADDRESS", "MAC_ADDRESS", "IBAN",
    "SWIFT_CODE", "URL", "URLDETECTOR", "USER_ID", "USERNAME", "PASSWORD", "TOKEN", "API_KEY",
    "ACCESS_KEY", "SECRET_KEY", "AWS_KEY", "GCP_KEY", "AZURE_KEY", "PRIVATE_KEY", "LICENSE_PLATE",
    "MEDICAL", "HEALTH", "NATIONAL_ID", "TAX_ID", "DRIVER_LICENSE", "VEHICLE_ID", "DEVICE_ID",
    "COOKIE", "SESSION_ID", "FACE_ID", "VOICE_ID", "FINGERPRINT", "BIOMETRIC", "GEOLOCATION",
    "LOCATION", "BANK_ACCOUNT", "ROUTING_NUMBER", "ACCOUNT_NUMBER", "CARD_NUMBER", "CVV",
    "EXPIRY_DATE", "SECURITY_CODE", "PIN", "MOTHER_MAIDEN_NAME", "BIRTHDATE", "BIRTH_PLACE",
    "EMPLOYEE_ID", "STUDENT_ID", "CUSTOMER_ID", "MEMBER_ID", "INSURANCE_ID", "POLICY_NUMBER",
    "ORDER_ID", "TRANSACTION_ID", "TICKET_ID", "RESERVATION_ID", "BOOKING_ID", "REFERENCE_NUMBER",
    "SERIAL_NUMBER", "IMEI", "IMSI", "MSISDN", "ICCID", "PLATE_NUMBER", "VIN",
    "REGISTRATION_NUMBER", "OTHER",
]
PII_TYPE_IGNORELIST = ["DATE_TIME", "TIME", "DATE", "DATETIME", "TIMESTAMP"]

DEFAULT_DETECTORS = [
    "CredentialDetector", "CreditCardDetector", "DriversLicenceDetector", "EmailDetector",
    "en_GB.NationalInsuranceNumberDetector", "PhoneDetector", "PostalCodeDetector",
    "en_US.SocialSecurityNumberDetector", "en_GB.TaxReferenceNumberDetector", "TwitterDetector",
    "UrlDetector", "VehicleLicencePlateDetector", "DateOfBirthDetector", "SkypeDetector",
    "TaggedEvaluationFilthDetector", "TextBlobNameDetector", "UserSuppliedFilthDetector",
    "IpAddressDetector",
]
SHIPPED_DETECTORS = (
    "CreditCardDetector|EmailDetector|UrlDetector|DateOfBirthDetector|IpAddressDetector|"
    "en_US.SocialSecurityNumberDetector|PhoneDetector|DriversLicenceDetector|PostalCodeDetector|"
    "en_GB.NationalInsuranceNumberDetector|en_GB.TaxReferenceNumberDetector|"
    "VehicleLicencePlateDetector"
)
FALLBACK_DETECTOR = "EmailDetector"

# --- Fixed values: mapping quality --------------------------------------------------------------

QUALITY_LABELS = [
    (90, "Excellent"), (80, "Good"), (60, "Fair"), (40, "Poor"), (0, "Critical"),
]
CONFIDENCE_BANDS = [(0.9, "success"), (0.7, "info"), (0.5, "warning")]
