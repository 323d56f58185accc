"""Word lists, lookup tables, patterns and weights.

They are part of the results (which column counts as what, how much a hit
weighs), so they are kept together, as plain text, in rule order.
"""

from __future__ import annotations

# ---------------------------------------------------------------- classification
# Column-name rules, tried category by category in this order.
NAME_RULES = [
    ("identifier", "high", [
        r"\b(id|identifier|uuid|guid|key)\b",
        r"\b(email|mail|e-mail)\b",
        r"\b(ssn|social.?security)\b",
        r"\b(username|user.?name|login)\b",
        r"\b(account|account.?number|acc.?no|acct)\b",
        r"\b(license|permit|registration|dl)\b",
        r"\b(aadhaar|aadhar|adhar|uidai|uid)\b",
        r"\b(pan|pancard|pan.?number)\b",
        r"\b(passport)\b",
        r"\b(voter.?id|voter)\b",
        r"\b(ifsc|ifsc.?code)\b",
    ]),
    ("quasi_identifier", "moderate", [
        r"\b(name|first.?name|last.?name|full.?name)\b",
        r"\b(age|birth|dob|date.?of.?birth)\b",
        r"\b(zip|zipcode|postal|postcode|pincode)\b",
        r"\b(phone|telephone|mobile|cell|phn|mob|contact)\b",
        r"\b(address|street|location|city|state|province|district)\b",
        r"\b(gender|sex)\b",
        r"\b(race|ethnicity|nationality|religion)\b",
        r"\b(occupation|job|title|position|profession)\b",
        r"\b(college|school|university|institute|clg|scl|clgname|sclname)\b",
    ]),
    ("sensitive", "critical", [
        r"\b(password|passwd|pwd|secret|token)\b",
        r"\b(credit.?card|card.?number|cvv|cvc)\b",
        r"\b(medical|health|diagnosis|condition|disease)\b",
        r"\b(salary|income|wage|compensation|pay|wealth)\b",
        r"\b(bank|routing|transaction|balance)\b",
        r"\b(tax|ein|tin|gst|gstin)\b",
    ]),
    ("temporal", "low", [
        r"\b(date|time|timestamp|datetime|created|updated|modified)\b",
        r"\b(year|month|day|hour|minute|second)\b",
    ]),
    ("geospatial", "moderate", [
        r"\b(lat|latitude|long|longitude|coord|gps)\b",
        r"\b(location|geo|position)\b",
    ]),
    ("numeric", "low", [
        r"\b(count|total|sum|amount|quantity|number)\b",
        r"\b(price|cost|value|revenue|budget)\b",
        r"\b(score|rating|rank|cibil)\b",
        r"\b(percentage|percent|ratio|rate)\b",
    ]),
]

# Value patterns in tie order, with the type and sensitivity they imply.
# Matching is case-insensitive and anchored at the start of the value.
VALUE_PATTERNS = [
    ("email", r"^[\w\.-]+@[\w\.-]+\.\w+$", "identifier", "high"),
    ("phone", r"^\+?[\d\s\-\(\)]{10,}$", "quasi_identifier", "moderate"),
    ("uuid", r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$", "identifier", "high"),
    ("ssn", r"^\d{3}-?\d{2}-?\d{4}$", "identifier", "critical"),
    ("credit_card", r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$", "sensitive", "critical"),
    ("date_iso", r"^\d{4}-\d{2}-\d{2}", "temporal", "low"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}.\d{2}:\d{2}:\d{2}", "temporal", "low"),
    ("gps", r"^-?\d+\.\d{4,},\s*-?\d+\.\d{4,}$", "geospatial", "moderate"),
    ("url", r"^https?://[\w\.-]+", "generic", "low"),
    ("ip_address", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", "quasi_identifier", "moderate"),
    ("password_hash", r"^[a-f0-9]{32,}$|^\$2[aby]\$[\d]+\$", "sensitive", "critical"),
]

# Signal weights and thresholds.
NAME_CONFIDENCE, NAME_WEIGHT = 0.8, 1.2
STATISTICS_WEIGHT = 0.8
PATTERN_SHARE = 0.8
CLASSIFY_SAMPLE_ROWS, PATTERN_SAMPLE_VALUES = 100, 50

# Recommended mechanism per column type (critical always redaction).
RECOMMENDED = {
    "identifier": "hashing",
    "quasi_identifier": "k_anonymity",
    "numeric": "laplace_noise",
    "categorical": "k_anonymity",
    "temporal": "generalization",
    "geospatial": "generalization",
    "sensitive": "redaction",
    "generic": "suppression",
}

# Default choices offered for a fixed-width layout, by name part.
LAYOUT_HASH_WORDS = ["id", "name", "ssn", "email"]
LAYOUT_NOISE_WORDS = ["age", "income", "salary", "cost"]

# ---------------------------------------------------------------- risk
# Texts that mark a value as already anonymized.
ANONYMIZED_MARKERS = ["[REDACTED]", "[DATE]", "[LOCATION]", "***", "REDACTED"]

# Value rules of the uniqueness check (pattern, ignore case, weight, driver).
UNIQUENESS_RULES = [
    (r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$", True, 80,
     "UUID-like identifiers present"),
    (r"^[\w\.-]+@[\w\.-]+\.\w+$", False, 90, "Email addresses detected (direct identifiers)"),
    (r"^\+?\d{10,13}$", False, 80, "Phone numbers detected"),
    ("long", False, 50, "Long unique values detected"),
    (r"^\d+\.\d{4,}$", False, 50, "Highly precise numerical values"),
]

# Rules of the sensitivity check on "field value" (pattern, driver, weight).
SENSITIVE_RULES = [
    (r"\b(password|passwd|pwd|secret)\b", "Potential credential data", 100),
    (r"\b(ssn|social.security)\b", "Social security patterns", 100),
    (r"\b(credit.card|card.number|cvv)\b", "Financial data patterns", 100),
    (r"\b(diagnosis|medical|health|patient)\b", "Healthcare-related data", 90),
    (r"\b(salary|income|wage|compensation)\b", "Financial compensation data", 80),
    (r"\b(address|street|apartment)\b", "Location data detected", 70),
    (r"\b(zip|zipcode|postal.?code|pincode)\b", "Postal/zip code (quasi-identifier)", 35),
    (r"\b(birth|dob)\b", "Birth date data", 55),
    (r"\bage\b", "Age data present", 35),
]
NAME_FIELD_PATTERN = (
    r"\b(full.?name|first.?name|last.?name|surname|customer.?name|patient.?name)\b"
)
NAME_FIELD_DRIVER, NAME_FIELD_WEIGHT = "Personal name field detected (quasi-identifier)", 65
PLAIN_NAME_DRIVER, PLAIN_NAME_WEIGHT = "Generic 'name' field detected", 50
ID_FIELD_WORDS = ["id", "uuid", "hash", "key", "token"]
SEQUENCE_FIELD_WORDS = ["file", "system", "record", "sl", "line"]
SEQUENCE_DRIVER, SEQUENCE_WEIGHT = "Internal sequence ID present", 15
DIRECT_ID_DRIVER, DIRECT_ID_WEIGHT = "Direct identifiers present", 65
AGE_VALUE_DRIVER, AGE_VALUE_WEIGHT = "Precise age values present", 25

# Risk of many filled attributes (at least n, weight, driver; {n} = count).
COMBINATION_RULES = [
    (15, 40, "High attribute count ({n} fields) increases re-identification risk"),
    (8, 25, "Multiple attributes ({n} fields) enable linking attacks"),
    (4, 20, "Combination of multiple data points"),
]

# Value rules of the precision check (pattern, weight, driver).
PRECISION_RULES = [
    (r"^\d{4}-\d{2}-\d{2}.\d{2}:\d{2}:\d{2}", 70, "Precise timestamps enable temporal correlation"),
    (r"^-?\d+\.\d{4,},\s*-?\d+\.\d{4,}$", 90, "GPS coordinates (exact location data)"),
    (r"^\d+\.\d{4,}$", 60, "High-precision measurements"),
]
EMPTY_RECORD_RISK, EMPTY_RECORD_DRIVER = 10.0, "Empty record"
NO_DATA_RISK, NO_DATA_DRIVER = 10, "No data to analyze"

# Dataset score weights, level bands and meter width.
MAX_SHARE, MEAN_SHARE = 0.4, 0.6
RISK_LEVELS = [(20, "Very Low Risk"), (40, "Low Risk"), (60, "Moderate Risk"), (80, "High Risk")]
TOP_RISK_LEVEL = "Very High Risk"
METER_CELLS = 20

# Protection group weights of the residual risk.
PROTECTION_WEIGHTS = {
    "dp": 1.00, "hashed": 0.95, "masked": 0.70,
    "generalized": 0.55, "suppressed": 0.40, "untouched": 0.00,
}
# Mechanism names per protection group.
MECHANISM_GROUPS = {
    "dp": ["laplace_noise", "gaussian_noise", "exponential", "dp"],
    "hashed": ["hashing", "pseudonymization", "redaction"],
    "masked": ["masking", "k_anonymity"],
    "suppressed": ["suppression"],
    "generalized": ["generalization", "bucketing", "rounding", "truncation"],
}
COVERAGE_DISCOUNT, RISK_FLOOR, RISK_FLOOR_SHARE = 0.40, 5.0, 0.05

# ---------------------------------------------------------------- transformations
# Noise pools.
INTEGER_POOL = [-3, -2, -1, 1, 2, 3]
CURRENCY_POOL = [-1500, -1000, -700, -600, -500, 500, 600, 700, 1000, 1500]

# Name parts that mark a money column.
CURRENCY_WORDS = [
    "salary", "income", "wage", "pay", "price", "cost", "amount",
    "revenue", "budget", "funding", "expenditure", "loan", "emi",
    "savings", "monthlyincome", "fee", "charge", "tax",
    "debt", "exp", "cons", "ern",
]
ROUNDED_WORDS = ["score", "rating", "percent"]

# Which treatment a quasi-identifier gets, by name part, first hit wins.
QUASI_DISPATCH = [
    ("pseudonym", ["name", "first", "last"]),
    ("email", ["email", "mail"]),
    ("phone", ["phone", "tel", "mobile"]),
    ("numeric", ["age", "year"]),
    ("location", ["address", "street", "city", "state"]),
]

# Key words for nested JSON text, first hit wins.
JSON_NAME_KEYS = ["name", "first", "last", "username"]
JSON_AADHAAR_KEYS = ["aadhaar", "aadhar", "adhar"]
JSON_PAN_KEYS = ["pan", "pancard", "pannumber"]
JSON_HASH_KEYS = [
    "recordid", "id", "ssn", "passport",
    "license", "licence", "drivinglicense", "dl",
    "account", "accountno", "accountnumber", "bankaccount",
    "card", "cardno", "cardnumber", "creditcard", "debit",
    "tax", "taxid", "tin", "gstin", "gst",
    "national", "nationalid", "voter", "voterid",
    "uid", "uniqueid", "personid", "customerid",
]
JSON_KEEP_KEYS = ["state", "address", "street", "city"]

# Marker texts counted as lost utility.
UTILITY_MARKERS = ["[REDACTED]", "[SUPPRESSED]", "[MASKED]", "[REGION]", "[DATE]", "[CATEGORY]"]

# Range labels. Age: upper bound inclusive.
AGE_RANGES = [
    (17, "0-17"), (25, "18-25"), (35, "26-35"), (45, "36-45"), (55, "46-55"),
    (65, "56-65"), (75, "66-75"), (85, "76-85"), (95, "86-95"),
]
AGE_TOP = "96-120"
# Income and land: the first bound is exclusive, the others inclusive.
INCOME_RANGES = [
    (10000, "0-10000"), (25000, "10000-25000"), (50000, "25000-50000"), (75000, "50000-75000"),
    (100000, "75000-100000"), (150000, "100000-150000"), (200000, "150000-200000"),
]
INCOME_TOP = "200000+"
HOUSEHOLD_RANGES = [(2, "1-2"), (5, "3-5"), (8, "6-8")]
HOUSEHOLD_TOP = "9-20"
LAND_RANGES = [
    (0.5, "0-0.5"), (1.0, "0.5-1.0"), (2.0, "1.0-2.0"), (3.0, "2.0-3.0"), (5.0, "3.0-5.0"),
    (10.0, "5.0-10.0"), (20.0, "10.0-20.0"), (50.0, "20.0-50.0"),
]
LAND_TOP = "50.0+"

# Protection settings by risk score (at least, epsilon, k, strict).
RISK_CONFIG = [(80, 0.5, 10, True), (60, 1.0, 7, False), (40, 2.0, 5, False), (0, 3.0, 3, False)]
DELTA = 1e-5
TRUTH_PROBABILITY = 0.75
SMALL_DATASET_ROWS = 10
CATEGORY_LIMIT = 10
NUMERIC_SHARE = 0.8

# ---------------------------------------------------------------- DP and budget
# Epsilon cost per query type, in hundredths.
QUERY_COST_CENTS = {"count": 1, "mean": 5, "sum": 10, "variance": 10, "std": 10}

# Sensitivity, lower and upper bound by field-name part, first hit wins.
FIELD_SENSITIVITY = [
    ("age", 1.5, 0, 120),
    ("employee", 2.0, 0, 5000),
    ("year", 1.5, 1900, 2100),
    ("experience", 1.0, 0, 50),
    ("household", 1.0, 1, 20),
    ("householdsize", 1.0, 1, 20),
    ("family", 1.0, 1, 20),
    ("size", 1.0, 1, 50),
    ("salary", 2000.0, 0, 1000000),
    ("income", 2000.0, 0, 1000000),
    ("monthlyincome", 2000.0, 0, 200000),
    ("wage", 2000.0, 0, 500000),
    ("pay", 2000.0, 0, 500000),
    ("land", 0.5, 0, 1000),
    ("acres", 0.5, 0, 1000),
    ("landowned", 0.5, 0, 1000),
    ("area", 0.5, 0, 10000),
    ("score", 5.0, 0, 100),
    ("rating", 5.0, 0, 100),
    ("grade", 5.0, 0, 100),
    ("percent", 5.0, 0, 100),
    ("count", 5.0, 0, 10000),
    ("quantity", 5.0, 0, 10000),
    ("number", 5.0, 0, 10000),
    ("price", 100.0, 0, 100000),
    ("cost", 100.0, 0, 100000),
    ("amount", 100.0, 0, 100000),
    ("revenue", 10000.0, 0, 10000000),
    ("budget", 10000.0, 0, 10000000),
    ("funding", 10000.0, 0, 10000000),
]
# The same by magnitude of a typical value (below, sensitivity, lower, upper).
MAGNITUDE_SENSITIVITY = [
    (10, 1.0, 0, 100), (100, 5.0, 0, 1000), (1000, 50.0, 0, 10000), (10000, 500.0, 0, 100000),
]
MAGNITUDE_TOP = (5000.0, 0, 10000000)
DEFAULT_SENSITIVITY = (1.0, 0, 1000)

# Budget defaults, in hundredths of epsilon.
DEFAULT_BUDGET_CENTS = 1000
HOURLY_REFILL_CENTS = 10
REFILL_INTERVAL_SECONDS = 3600
DB_REFILL_SHARE = 0.1
# Budget bands (above percent, status, degradation factor).
BUDGET_BANDS = [(50, "HIGH", 1.0), (25, "MEDIUM", 2.0), (10, "LOW", 5.0)]
BUDGET_BOTTOM = ("CRITICAL", 10.0)
STATUS_ORDER = ["HIGH", "MEDIUM", "LOW", "CRITICAL"]
AUDIT_LIMIT = 100
BLOCKED_SQL_WORDS = [
    "DROP", "DELETE", "TRUNCATE", "ALTER", "INSERT", "UPDATE", "EXEC", "EXECUTE",
    "UNION", "SLEEP", "BENCHMARK", "OUTFILE", "LOAD_FILE",
]
TABLE_CAP, QUERY_CAP, PREVIEW_ROWS = 500, 100, 50

# ---------------------------------------------------------------- policies
# Protection levels.
LEVELS = {"MINIMAL": 1, "STANDARD": 2, "STRICT": 3, "MAXIMUM": 4}
# Policies (name, title, level, epsilon, delta, k, quasi, noise, categories,
# statistics kept, t-closeness, l-diversity, utility weight, description).
POLICIES = [
    ("minimal", "Minimal Protection", "MINIMAL", 5.0, 1e-4, 3, False, False, False,
     True, False, False, 0.9, "Basic privacy with maximum utility preservation"),
    ("standard", "Standard Protection", "STANDARD", 2.0, 1e-5, 5, True, True, True,
     True, False, False, 0.5, "Balanced privacy and utility"),
    ("strict", "Strict Protection", "STRICT", 1.0, 1e-6, 10, True, True, True,
     False, False, True, 0.3, "Strong privacy with moderate utility"),
    ("maximum", "Maximum Protection", "MAXIMUM", 0.5, 1e-7, 20, True, True, True,
     False, True, True, 0.1, "Maximum privacy, utility may be limited"),
    ("research", "Research Policy", "STANDARD", 2.5, 1e-5, 5, True, True, False,
     True, False, False, 0.7, "Preserve statistical properties for research"),
    ("production", "Production Policy", "STRICT", 1.0, 1e-6, 7, True, True, True,
     True, False, True, 0.4, "Production-grade privacy protection"),
    ("healthcare", "Healthcare Policy (HIPAA)", "STRICT", 0.8, 1e-6, 10, True, True, True,
     True, True, True, 0.3, "HIPAA-compliant privacy for healthcare"),
    ("financial", "Financial Policy", "STRICT", 1.0, 1e-6, 10, True, True, True,
     True, False, True, 0.4, "Privacy for financial data"),
]
# Level of a custom policy by epsilon (at least, level).
CUSTOM_LEVELS = [(3.0, "MINIMAL"), (1.5, "STANDARD"), (0.8, "STRICT")]
CUSTOM_TOP_LEVEL = "MAXIMUM"
# Requirements by risk (from score, min epsilon, max epsilon, min k, strict,
# utility loss allowed, description).
RISK_BANDS = [
    (80, 0.5, 1.0, 10, True, True, "Very high risk - maximum protection required"),
    (60, 1.0, 2.0, 7, True, False, "High risk - strict protection required"),
    (40, 2.0, 3.0, 5, False, False, "Moderate risk - standard protection"),
    (0, 3.0, 5.0, 3, False, False, "Low risk - basic protection sufficient"),
]
# Methods allowed per kind of column and the protection it needs.
COLUMN_RULES = [
    ("email", ["masking", "hashing", "pseudonymization"], "high"),
    ("ssn", ["redaction", "hashing"], "critical"),
    ("name", ["pseudonymization", "masking", "generalization"], "moderate"),
    ("age", ["laplace_noise", "bucketing", "generalization"], "moderate"),
    ("salary", ["gaussian_noise", "bucketing"], "high"),
    ("phone", ["masking", "hashing"], "moderate"),
    ("address", ["generalization", "suppression"], "moderate"),
    ("password", ["redaction"], "critical"),
    ("ip_address", ["masking", "hashing", "generalization"], "moderate"),
]
# Further demands of a column's rule. All rules demand a treatment.
COLUMN_RULE_LIMITS = {
    "email": {"preserve_domain": "false"},
    "ssn": {"preserve_format": "false"},
    "name": {"preserve_length": "true"},
    "age": {"max_noise": "5"},
    "salary": {"max_noise_percentage": "10"},
    "phone": {"preserve_last_digits": "4"},
    "address": {"generalize_to": "city_level"},
    "password": {"allow_view": "false"},
    "ip_address": {"preserve_subnet": "false"},
}
# Cost multiplier of a similar query (none, same user, other user).
SIMILAR_MULTIPLIER = (1.0, 2.0, 3.0)
SIMILAR_WINDOW_SECONDS = 86400

# ---------------------------------------------------------------- fixed-width layouts
# Household record, (field, first byte, last byte), 128 bytes.
HOUSEHOLD_LAYOUT = [
    ("FILE_ID", 1, 5), ("SCHEDULE", 6, 8), ("QUARTER", 9, 10), ("MONTH", 11, 12),
    ("VISIT", 13, 14), ("SECTOR", 15, 15), ("STATE_UT", 16, 17), ("DISTRICT", 18, 19),
    ("NSS_REGION", 20, 22), ("BASIC_STRATUM", 23, 26), ("STRATUM", 27, 29), ("GROUP", 30, 30),
    ("SUB_STRATUM", 31, 32), ("FOD_SUB_REGION", 33, 36), ("FSU", 37, 41),
    ("STAGE2_STRATUM", 42, 42), ("SAMPLE_HH_NO", 43, 44), ("MONTH_SURVEY", 45, 46),
    ("RESPONSE_CODE", 47, 47), ("SURVEY_CODE", 48, 48), ("REASON_SUBST", 49, 49),
    ("HH_SIZE", 50, 51), ("HH_TYPE", 52, 52), ("RELIGION", 53, 53), ("SOCIAL_GROUP", 54, 54),
    ("HH_CONS_EXP", 55, 64), ("LAND_POSSESSED", 65, 66), ("LAND_LEASED_OUT", 67, 68),
    ("HH_INCOME", 69, 78), ("INFORMANT_SL", 79, 80), ("SURVEY_DATE", 81, 90),
    ("TIME_CANVASS", 91, 94), ("NS_COUNT", 95, 97), ("MULTIPLIER", 98, 107),
    ("TOTAL_SUBDIV", 108, 110), ("STRATUM_SIZE", 111, 120), ("LISTED_HH", 121, 124),
    ("SELECTED_HH", 125, 126), ("PANEL_CODE", 127, 128),
]
# Person record. Bytes 1-44 are the household fields of the same bytes; then
# person fields, seven equal day blocks (day 7 first) and the weekly totals.
PERSON_FIELDS = [
    ("PERSON_SL", 45, 46), ("RELATION_HEAD", 47, 47), ("GENDER", 48, 48), ("AGE", 49, 51),
    ("MARITAL_STATUS", 52, 52), ("GEN_EDUC", 53, 54), ("TECH_EDUC", 55, 56),
]
DAY_BLOCK_START, DAY_BLOCK_WIDTH, DAYS = 57, 26, 7
DAY_FIELDS = [  # (name with block number, offset in block, width)
    ("DAS1{n}", 0, 2), ("IND1{n}", 2, 2), ("HR1{n}", 4, 2), ("ERN1{n}", 6, 5),
    ("DAS2{n}", 11, 2), ("IND2{n}", 13, 2), ("HR2{n}", 15, 2), ("ERN2{n}", 17, 5),
    ("HR{n}", 22, 2), ("AHR{n}", 24, 2),
]
WEEK_FIELDS = [
    ("TOTHRS_WRK", 239, 241), ("TOTADL_WRK", 242, 244), ("ACWS", 245, 246),
    ("AIND_CWS", 247, 248), ("OCU_CWS", 249, 251), ("ERN_REG", 252, 259), ("ERN_SELF", 260, 267),
]
PERSON_LINE_LENGTH = 200
