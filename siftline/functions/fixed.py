"""Patterns, word lists and limits that results depend on."""

# --- cell checks -----------------------------------------------------------
# Fixed values.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://.+"
PHONE_PUNCTUATION = r"[\s\-()+.]"
PHONE_DIGITS = r"^[0-9]{7,15}$"
BOOLEAN_TOKENS = ["true", "false", "1", "0", "yes", "no", "t", "f"]
TRUE_TOKENS = ["true", "1", "yes", "y"]
FALSE_TOKENS = ["false", "0", "no", "n"]
TRUE_TOKENS_SHORT = ["t"]
FALSE_TOKENS_SHORT = ["f"]
RECORD_ID_LENGTHS = [15, 18]
NUMBER_FIELD_WORDS = ["postal", "zip", "code", "id", "number"]
ADDRESS_FIELD_WORDS = ["street", "address", "billing", "shipping"]
ADDRESS_NUMBER_LIMIT = 9999
TEXT_NUMBER_LIMIT = 99999
TYPE_LENGTHS = {
    "text": 255,
    "string": 255,
    "textarea": 32768,
    "longtextarea": 131072,
    "email": 80,
    "phone": 40,
    "url": 255,
}

# --- column type detection ---------------------------------------------------
# Fixed values.
DETECT_BOOLEAN = ["true", "false", "1", "0", "yes", "no"]
DETECT_EMAIL = r"@.*\."
DETECT_PHONE = r"[\d\-\(\)\+\s]{10,}"
DETECT_URL = r"https?://"

# --- mapping suggestions -----------------------------------------------------
# Fixed values.
SKIP_FIELD = "-- Skip Field --"
FIELD_ALIASES = {
    "id": ["Id", "External_Id__c"],
    "name": ["Name", "Account_Name__c", "Full_Name__c"],
    "accountname": ["Name"],
    "companyname": ["Name"],
    "email": ["Email", "Email__c", "PersonEmail"],
    "phone": ["Phone", "Phone__c", "MobilePhone"],
    "website": ["Website", "Website__c"],
    "description": ["Description", "Description__c"],
    "type": ["Type", "Type__c"],
    "industry": ["Industry", "Industry__c"],
    "billingstreet": ["BillingStreet"],
    "billingcity": ["BillingCity"],
    "billingstate": ["BillingState"],
    "billingcountry": ["BillingCountry"],
    "billingpostalcode": ["BillingPostalCode"],
    "shippingstreet": ["ShippingStreet"],
    "shippingcity": ["ShippingCity"],
    "shippingstate": ["ShippingState"],
    "shippingcountry": ["ShippingCountry"],
    "shippingpostalcode": ["ShippingPostalCode"],
}
NAME_KEYWORDS = [
    "name", "phone", "email", "address", "account", "contact", "date", "status", "type", "number",
]
SYSTEM_PREFIXES = ["Created", "LastModified", "System"]
EXCLUDED_FIELD_WORDS = ["ownerid", "isdeleted", "sic", "createdby"]

# --- rule text: field mentions -------------------------------------------------
# Fixed values. Each entry: pattern, words (in lower case) of which at least one
# must occur in the text for the pattern to match at all.
FIELD_MENTIONS = [
    (r"'([^']+)'\s+(?:field|must|cannot|should|is|are)", ["field", "must", "cannot", "should", "is", "are"]),
    (r'"([^"]+)"\s+(?:field|must|cannot|should|is|are)', ["field", "must", "cannot", "should", "is", "are"]),
    (r"^([A-Za-z][A-Za-z0-9_\s]*?)\s+(?:must|cannot|should|is required|is mandatory|field)",
     ["must", "cannot", "should", "is required", "is mandatory", "field"]),
    (r"([A-Za-z][A-Za-z0-9_\s]*?)\s+(?:must be|cannot be|should be|is required|is mandatory)",
     ["must be", "cannot be", "should be", "is required", "is mandatory"]),
    (r"(?:enter|provide|fill|specify|input|select)\s+(?:a\s+|an\s+|the\s+|valid\s+)?([A-Za-z][A-Za-z0-9_\s]*?)(?:\s|$|\.)",
     ["enter", "provide", "fill", "specify", "input", "select"]),
    (r"(?:invalid|missing|empty|blank|incorrect|wrong)\s+([A-Za-z][A-Za-z0-9_\s]*?)(?:\s|$|\.)",
     ["invalid", "missing", "empty", "blank", "incorrect", "wrong"]),
    (r"for\s+(?:the\s+)?([A-Za-z][A-Za-z0-9_\s]*?)(?:\s|$|\.)", ["for"]),
    (r"([A-Za-z][A-Za-z0-9_\s]*?)\s+field", ["field"]),
    (r"([A-Za-z][A-Za-z0-9_\s]*?)'s\s+(?:value|format|length)", ["'s"]),
    (r"when\s+([A-Za-z][A-Za-z0-9_\s]*?)\s+(?:is|equals|contains)", ["when"]),
    (r"([A-Za-z][A-Za-z0-9_\s]*?)\s+(?:format|type|value|number|date|email|phone)",
     ["format", "type", "value", "number", "date", "email", "phone"]),
]
# Fixed values. Further mentions tried only when a rule's field is resolved.
FIELD_MENTIONS_RESOLVE = [
    (r"'([^']+)'\s+(?:field|is|must|cannot|should)", ["field", "is", "must", "cannot", "should"]),
    (r"(?:field|the)\s+'([^']+)'", ["field", "the"]),
    (r"([A-Za-z_][A-Za-z0-9_]*)\s+(?:is|must|cannot|should)", ["is", "must", "cannot", "should"]),
    (r"please\s+(?:enter|provide|fill)\s+(?:a\s+)?([A-Za-z_][A-Za-z0-9_]*)", ["please"]),
]
STOP_WORDS = [
    "a", "an", "the", "is", "are", "be", "and", "or", "not", "for", "to", "in", "on", "at", "by", "with",
]
RULE_WORDS = [
    "required", "mandatory", "optional", "valid", "invalid", "format", "pattern", "value", "number", "text",
]

# --- rule text: constraints ------------------------------------------------------
# Fixed values. Each entry: pattern, words (in lower case) of which at least one
# must occur in the text for the pattern to match at all.
REQUIRED_TEXT = [
    (r"(?:is\s+)?required", ["required"]),
    (r"(?:is\s+)?mandatory", ["mandatory"]),
    (r"cannot\s+be\s+(?:blank|empty|null)", ["cannot"]),
    (r"must\s+not\s+be\s+(?:blank|empty|null)", ["must"]),
    (r"(?:must|should)\s+be\s+(?:provided|filled|specified)", ["must", "should"]),
    (r"please\s+(?:enter|provide|fill|specify)", ["please"]),
]
RANGE_TEXT = [
    (r"between\s+(\d+(?:\.\d+)?)\s+and\s+(\d+(?:\.\d+)?)", ["between"]),
    (r"from\s+(\d+(?:\.\d+)?)\s+to\s+(\d+(?:\.\d+)?)", ["from"]),
    (r"(\d+(?:\.\d+)?)\s*(?:to|-)\s*(\d+(?:\.\d+)?)", ["to", "-"]),
    (r"(?:in\s+the\s+)?range\s+(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)", ["range"]),
]
# Fixed values. A message rule reads "3-5" as a range only with a unit.
RANGE_TEXT_WITH_UNIT = [
    RANGE_TEXT[0],
    RANGE_TEXT[1],
    (r"(\d+(?:\.\d+)?)\s*(?:to|-)\s*(\d+(?:\.\d+)?)\s+(?:years?|dollars?|range)", ["year", "dollar", "range"]),
    RANGE_TEXT[3],
]
MINIMUM_TEXT = [
    (r"(?:minimum|min|at\s+least|greater\s+than\s+or\s+equal\s+to|>=)\s+(\d+(?:\.\d+)?)", ["min", "least", "greater", ">="]),
    (r"must\s+be\s+(\d+(?:\.\d+)?)\s+or\s+(?:more|greater|higher)", ["must"]),
    (r"(?:no\s+less\s+than|not\s+less\s+than)\s+(\d+(?:\.\d+)?)", ["less"]),
]
MAXIMUM_TEXT = [
    (r"(?:maximum|max|at\s+most|no\s+more\s+than|less\s+than\s+or\s+equal\s+to|<=)\s+(\d+(?:\.\d+)?)",
     ["max", "most", "more", "less", "<="]),
    (r"must\s+be\s+(\d+(?:\.\d+)?)\s+or\s+(?:less|fewer|lower)", ["must"]),
    (r"(?:cannot\s+exceed|should\s+not\s+exceed|must\s+not\s+exceed)\s+(\d+(?:\.\d+)?)", ["exceed"]),
]
# Fixed values, most specific kind first: kind, pattern, words.
LENGTH_TEXT = [
    ("min_length", r"(?:minimum|min|at\s+least)\s+(\d+)\s+characters?", ["character"]),
    ("min_length", r"(?:must\s+be\s+at\s+least|should\s+be\s+at\s+least)\s+(\d+)\s+characters?", ["character"]),
    ("max_length", r"(?:maximum|max|at\s+most|no\s+more\s+than)\s+(\d+)\s+characters?", ["character"]),
    ("max_length", r"(?:must\s+not\s+exceed|cannot\s+exceed)\s+(\d+)\s+characters?", ["character"]),
    ("length_range", r"between\s+(\d+)\s+and\s+(\d+)\s+characters?", ["character"]),
    ("length_range", r"(\d+)\s*(?:to|-)\s*(\d+)\s+characters?", ["character"]),
    ("exact_length", r"(?:must\s+be\s+|exactly\s+|should\s+be\s+)?(\d+)\s+characters?\s+(?:long|in\s+length)", ["character"]),
    ("exact_length", r"length\s+(?:of\s+|must\s+be\s+|should\s+be\s+)?(\d+)", ["length"]),
]
FORMAT_TEXT = [
    ("email", [(r"(?:valid\s+)?email(?:\s+address)?(?:\s+format)?", ["email"]), (r"@.*\..*format", ["format"]),
               (r"electronic\s+mail", ["electronic"])]),
    ("phone", [(r"(?:valid\s+)?phone(?:\s+number)?(?:\s+format)?", ["phone"]), (r"telephone(?:\s+number)?", ["telephone"]),
               (r"\d{3}[-.]?\d{3}[-.]?\d{4}", ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9"])]),
    ("date", [(r"(?:valid\s+)?date(?:\s+format)?", ["date"]), (r"mm/dd/yyyy|dd/mm/yyyy|yyyy-mm-dd", ["yyyy"]),
              (r"date\s+format", ["date"])]),
    ("url", [(r"(?:valid\s+)?url(?:\s+format)?", ["url"]), (r"web(?:site)?\s+address", ["address"]), (r"http[s]?://", ["http"])]),
    ("zip", [(r"(?:zip|postal)\s+code", ["code"]), (r"\d{5}(?:-\d{4})?", ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9"])]),
    ("ssn", [(r"social\s+security\s+number", ["social"]), (r"ssn", ["ssn"]), (r"\d{3}-\d{2}-\d{4}", ["-"])]),
]
CUSTOM_FORMAT_TEXT = [
    (r'format\s+(?:must\s+be|should\s+be)\s+"([^"]+)"', ["format"]),
    (r'pattern\s+"([^"]+)"', ["pattern"]),
    (r'must\s+match\s+(?:the\s+)?pattern\s+"([^"]+)"', ["pattern"]),
]
ALLOWED_TEXT = [
    # The whole quoted list that follows the words, so that every value of it is allowed.
    (r"""must\s+be\s+(?:one\s+of\s+)?(?:the\s+following:?\s*)?(["'][^"']+["'](?:\s*,?\s*(?:or\s+|and\s+)?["'][^"']+["'])*)""", ["must"]),
    (r"""(?:only\s+|should\s+be\s+)?(?:one\s+of\s+)?["']([^"']+)["'](?:\s+(?:or|,)\s+["']([^"']+)["'])*""", ['"', "'"]),
    (r"""valid\s+values?\s+(?:are|include)?\s*:?\s*["']([^"']+)["']""", ["valid"]),
]
QUOTED = r"""["']([^"']+)["']"""
PROHIBITED_TEXT = [
    (r"""cannot\s+be\s+["']([^"']+)["']""", ["cannot"]),
    (r"""(?:not\s+allowed\s+to\s+be|should\s+not\s+be)\s+["']([^"']+)["']""", ["allowed", "should"]),
    (r"""prohibited\s+values?\s*:?\s*["']([^"']+)["']""", ["prohibited"]),
]
CONDITION_TEXT = [
    (r"""when\s+([A-Za-z][A-Za-z0-9_\s]*?)\s+(?:is|equals?|contains?)\s+["']([^"']+)["']""", ["when"]),
    (r"""if\s+([A-Za-z][A-Za-z0-9_\s]*?)\s+(?:is|equals?|contains?)\s+["']([^"']+)["']""", ["if"]),
    (r"""only\s+when\s+([A-Za-z][A-Za-z0-9_\s]*?)\s+(?:is|equals?)\s+["']([^"']+)["']""", ["when"]),
]
UNIQUE_TEXT = [
    (r"must\s+be\s+unique", ["unique"]),
    (r"(?:already\s+exists|duplicate\s+(?:value|entry))", ["already", "duplicate"]),
    (r"uniqueness\s+(?:constraint|violation)", ["uniqueness"]),
    (r"cannot\s+be\s+(?:duplicated|the\s+same)", ["cannot"]),
]
# Fixed values. A text with this word limits lengths, never numeric values.
LENGTH_WORD = "characters"

# --- rule text: message rules ------------------------------------------------------
# Fixed values.
FIELD_KIND_WORDS = [
    ("name", ["name", "full name", "first name", "last name", "company name", "account name"]),
    ("email", ["email", "e-mail", "email address", "@", "electronic mail"]),
    ("phone", ["phone", "telephone", "mobile", "contact number", "phone number", "cell"]),
    ("address", ["address", "street", "city", "state", "zip", "postal", "country"]),
    ("date", ["date", "birth date", "start date", "end date", "created date"]),
    ("amount", ["amount", "price", "cost", "value", "total", "sum"]),
    ("status", ["status", "state", "stage", "phase"]),
    ("type", ["type", "category", "classification", "kind"]),
    ("id", ["id", "identifier", "reference", "number", "code"]),
]
BLANK_FAILS_WORDS = [
    "required", "mandatory", "cannot be blank", "must not be empty", "must not be null", "is required",
    "should not be empty", "must be filled", "cannot be empty", "must have a value", "field is required",
    "please enter", "please provide",
]
REQUIRED_WORDS = BLANK_FAILS_WORDS + ["fill in", "must specify", "needs to be provided"]
ALSO_FORMAT_WORDS = [
    "format", "pattern", "valid format", "email format", "phone format", "must match", "invalid format",
    "format should be",
]
EMAIL_WORDS = [
    "email", "e-mail", "@", "email format", "valid email", "email address", "electronic mail", "mail format",
    "invalid email", "email pattern",
]
PHONE_WORDS = [
    "phone", "telephone", "mobile", "contact number", "phone number", "cell", "cellular", "phone format",
    "invalid phone", "telephone number", "contact info",
]
DATE_WORDS = [
    "date", "invalid date", "date format", "date range", "future date", "past date", "before today",
    "after today", "date field", "birth date", "start date", "end date",
]
NUMBER_WORDS = [
    "number", "numeric", "integer", "decimal", "amount", "must be a number", "invalid number",
    "positive number", "negative number", "greater than", "less than", "price", "cost", "value", "total",
    "sum", "quantity",
]
LENGTH_WORDS = [
    "length", "characters", "minimum length", "maximum length", "too long", "too short", "character limit",
    "exceed", "min length", "max length", "char count",
]
FORMAT_WORDS = [
    "format", "pattern", "invalid format", "valid format", "alphanumeric", "special characters", "contains",
    "must match", "format should be", "pattern must be",
]
UNIQUE_WORDS = [
    "duplicate", "already exists", "unique", "must be unique", "uniqueness", "cannot duplicate",
    "existing record",
]
BUSINESS_WORDS = [
    "status", "state", "condition", "relationship", "dependency", "business rule", "policy", "must be",
    "cannot be when", "if then", "only when", "except when",
]
CRITICAL_WORDS = ["error", "invalid", "wrong", "incorrect", "not allowed", "forbidden"]
UNRESOLVED_FAILS_WORDS = ["required", "mandatory", "cannot be blank", "must not be empty", "error", "invalid"]
FUTURE_WORDS = ["future date", "after today"]
PAST_WORDS = ["past date", "before today"]
STATUS_VALUES = ["active", "inactive", "pending", "approved", "rejected", "draft"]
STAGE_VALUES = ["new", "qualified", "proposal", "negotiation", "closed won", "closed lost"]
TOO_LONG = 255

# --- rule text: identifiers and grading -----------------------------------------------
# Fixed values.
IDENTIFIER = r"\b([A-Za-z0-9_]+(?:__c)?)\b"
FUNCTION_WORDS = ["AND", "OR", "NOT", "IF", "ISBLANK", "LEN", "ISPICKVAL", "TRUE", "FALSE", "NULL"]
HIGH_RISK_WORDS = ["restrict", "block", "prevent", "mandatory", "required"]
MEDIUM_RISK_WORDS = ["validate", "check", "ensure"]
SCENARIOS = [
    ("restrict", "Access Control"),
    ("wholesaler", "Distribution Channel Management"),
    ("status", "Lifecycle Management"),
    ("parent", "Hierarchy Validation"),
    ("billing", "Financial Data Validation"),
    ("required", "Data Completeness"),
]
DEFAULT_SCENARIO = "General Business Rule"
COVERAGE_LEVELS = [(90, "Excellent"), (75, "Good"), (60, "Adequate"), (40, "Limited")]
COVERAGE_LOWEST = "Poor"
QUALITY_LEVELS = [(95, "Excellent"), (80, "Good"), (60, "Fair")]
QUALITY_LOWEST = "Poor"
COMPLEXITY_LEVELS = [(120, "Very High"), (70, "High"), (35, "Medium"), (15, "Low")]
COMPLEXITY_LOWEST = "Very Low"
COMPLEXITY_WEIGHTS = {
    "total_fields": 0.3,
    "required_fields": 2.5,
    "picklist_fields": 1.5,
    "reference_fields": 3.0,
    "custom_fields": 1.2,
    "updateable_fields": 0.2,
}

# --- run logs -----------------------------------------------------------------------
# The column names of the two log files.
SUMMARY_LOG_SCHEMA = (
    "Start_Time TIMESTAMP, End_Time TIMESTAMP, Processing_Duration_Seconds DOUBLE, "
    "Processing_Duration_Formatted STRING, Total_Records LONG, Total_Success LONG, Total_Errors LONG, "
    "Total_Unprocessed LONG, Success_Rate_Percent DOUBLE, Error_Rate_Percent DOUBLE, Operation STRING, "
    "Salesforce_Object STRING, Salesforce_Org STRING, Total_Batches INT, Parallel_Processing BOOLEAN, "
    "Log_Generated_At TIMESTAMP"
)
BATCH_LOG_SCHEMA = (
    "Batch_Number INT, Batch_Records LONG, Batch_Success LONG, Batch_Errors LONG, "
    "Batch_Processing_Time_Seconds DOUBLE, Batch_Success_Rate_Percent DOUBLE, Batch_Error_Rate_Percent DOUBLE, "
    "Batch_Status STRING, Error_Details STRING"
)
