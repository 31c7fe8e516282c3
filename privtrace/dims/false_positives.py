"""False-positive dictionary: rules per entity, and the context word lists."""
from __future__ import annotations

# --- fixed values -----------------------------------------------------------
FALSE_POSITIVES = {
    "LOCATION": {
        "exact": ["the city", "state", "city", "town", "village", "county", "country",
                  "wy", "me", "in", "or", "oh", "ok", "pa", "va", "wa", "wi"],
        "prefix": ["state your", "city of the", "the state"],
        "contains": ["experienced", "preferences", "officials", "council"],
    },
    "DATE_TIME": {
        "exact": ["today", "yesterday", "tomorrow", "monday", "tuesday", "wednesday",
                  "thursday", "friday", "saturday", "sunday", "january", "february",
                  "march", "april", "may", "june", "july", "august", "september",
                  "october", "november", "december", "q1", "q2", "q3", "q4",
                  "15 minutes", "30 minutes", "1 hour", "2 hours", "minutes", "hours",
                  "monthly", "daily", "annual", "weekly", "yearly", "the last month",
                  "the month", "a few days", "4-6 weeks", "6-month"],
        "contains": ["century", "era", "epoch", "version", "minutes", "appointment", "scheduled", "week"],
    },
    "STREET": {
        "contains": ["performance", "smart", "wall street journal", "sesame street"],
        "prefix": ["street performance", "street food", "street art", "street style"],
    },
    "COMPANY_NAME": {
        "exact": ["the company", "company", "the firm", "the organization"],
        "contains": ["grew", "announced", "reported", "declined"],
    },
    "NAME_PREFIX": {"exact": ["dr.", "mr.", "mrs.", "ms.", "prof.", "rev."]},
    "GENDER": {
        "exact": ["male", "female"],
        "contains": ["connector", "thread", "plug", "socket", "adapter", "cable", "port"],
    },
    "PERSON": {
        "exact": ["user", "admin", "administrator", "system", "agent", "customer",
                  "patient", "client", "member", "staff", "employee", "manager",
                  "user authentication", "authentication successful", "session started",
                  "specialist", "analyst", "coordinator", "officer", "finance specialist",
                  "reference check specialist", "hr coordinator", "data specialist",
                  "provider", "doctor", "dr.", "nurse", "lifestyle", "treatment"],
        "contains": ["authentication", "session", "login", "successful", "logged in",
                     "access granted", "access denied", "permission", "authorized",
                     "specialist", "coordinator", "analyst", "officer", "manager",
                     "customer inquiry", "wire transfer", "account ending"],
        "prefix": ["user id", "session id", "user name", "[info]", "[debug]", "[error]",
                   "address the", "prepare a", "answer", "summarize"],
    },
    "URL": {
        "contains": ["api/v1", "/internal/", "localhost", "127.0.0.1", "example.com"],
        "prefix": ["http://api.", "https://api."],
    },
    "NRP": {
        "exact": ["api", "v1", "v2", "post", "get", "put", "delete",
                  "transfer", "address", "delegate", "complete", "specific",
                  "information", "diagnosis", "customer", "client", "inquiry",
                  "wire", "account", "limits", "request", "response"],
        "contains": ["/api/", "/v1/", "/v2/", "endpoint", "inquiry", "regarding"],
    },
    "USERNAME": {
        "exact": ["user", "admin", "root", "system", "guest", "anonymous"],
        "contains": ["authentication", "session", "login", "successful", "logged in",
                     "access granted", "access denied", "authorized", "started"],
        "prefix": ["user ", "[info]", "[debug]", "[error]", "[warn]"],
    },
    "MEDICAL_NOTE": {
        "exact": ["lisinopril", "atorvastatin", "metformin", "amlodipine", "metoprolol",
                  "omeprazole", "simvastatin", "losartan", "gabapentin", "hydrochlorothiazide",
                  "sertraline", "acetaminophen", "ibuprofen", "aspirin", "prednisone",
                  "levothyroxine", "azithromycin", "amoxicillin", "pantoprazole", "furosemide",
                  "tramadol", "alprazolam", "citalopram", "trazodone", "fluoxetine",
                  "montelukast", "escitalopram", "duloxetine", "bupropion", "carvedilol",
                  "pravastatin", "rosuvastatin", "venlafaxine", "clonazepam", "warfarin",
                  "meloxicam", "albuterol", "tamsulosin", "potassium", "insulin",
                  "penicillin", "sulfa", "latex", "peanuts", "shellfish", "eggs", "dairy",
                  "gluten", "soy", "tree nuts", "fish", "wheat", "sesame",
                  "aspirin allergy", "nsaid", "codeine", "morphine", "contrast dye",
                  "none", "none disclosed", "n/a", "not applicable", "unknown",
                  "self-represented", "passed", "failed", "pending", "cleared"],
        "contains": ["mg", "tablet", "capsule", "daily", "twice daily", "as needed"],
    },
    "DIAGNOSIS": {
        "exact": ["none", "none disclosed", "n/a", "healthy", "routine checkup",
                  "patient stable", "continue current treatment"],
    },
}
# a bare number in this range is a year or a size, not a date
DATE_NUMBER_RANGE = (1000, 2100)

BIRTH_WORDS = ["dob", "date of birth", "birth date", "birthday", "born", "patient"]
API_WORDS = ["api", "post", "get", "request", "appointment", "schedule",
             "booking", "/v1/", "/v2/", "endpoint", "query", "'date':", '"date":']
LOG_WORDS = ["[info]", "[debug]", "[error]", "[warn]", "log:", "logger",
             "authentication", "authorized", "session", "successful", "started"]
GENERIC_ACTORS = ["user", "admin", "system", "service", "client", "agent"]
SYSTEM_PHRASES = ["user authentication", "session started", "authentication successful",
                  "system error", "admin access", "service started", "client connected"]
CONTEXT_CHARS = 30
# ---------------------------------------------------------------------------
