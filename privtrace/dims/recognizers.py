"""Recognizer catalogue: 45 entities, 110 patterns, plus the general entities."""
from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# entity, [(pattern, score), ...], context words
RECOGNIZERS = [
    ("PATIENT_ID", [(r"\bPT-\d{6}\b", 0.9)], ["patient", "id", "medical", "record", "health"]),
    ("IMEI", [(r"\b\d{2}[- ]?\d{6}[- ]?\d{6}[- ]?\d{1}\b", 0.8)], ["imei", "device", "phone", "mobile"]),
    ("VIN", [(r"\b[A-HJ-NPR-Z0-9]{17}\b", 0.85)], ["vin", "vehicle", "car", "license", "registration"]),
    ("CRYPTO_ADDRESS", [
        (r"\b1[1-9A-HJ-NP-Za-km-z]{25,34}\b", 0.95),
        (r"\b3[1-9A-HJ-NP-Za-km-z]{25,34}\b", 0.95),
        (r"\bbc1[a-z0-9]{39,59}\b", 0.95),
        (r"\b0x[a-fA-F0-9]{40}\b", 0.95),
        (r"\bL[1-9A-HJ-NP-Za-km-z]{26,33}\b", 0.95),
        (r"\bM[1-9A-HJ-NP-Za-km-z]{26,33}\b", 0.95),
    ], ["bitcoin", "ethereum", "crypto", "wallet", "address", "btc", "eth", "litecoin", "ltc"]),
    ("VRM", [(r"\b[A-Z]{2}[0-9]{2}[A-Z]{3}\b", 0.85)], ["registration", "plate", "vehicle", "car"]),
    ("GPS_COORDINATE", [
        (r"\[\s*-?\d+\.\d+\s*,\s*-?\d+\.\d+\s*\]", 0.9),
        (r"\b-?\d{1,3}\.\d{4,},\s*-?\d{1,3}\.\d{4,}\b", 0.7),
    ], ["location", "coordinate", "gps", "latitude", "longitude", "position"]),
    ("BIC_SWIFT", [
        (r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}\b", 0.4),
        (r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}[A-Z0-9]{3}\b", 0.5),
        (r"\b(?:BIC|SWIFT)[:\s]*[A-Z]{6,11}\b", 0.9),
    ], ["bic", "swift", "bank", "transfer", "wire", "code"]),
    ("PIN_CODE", [(r"\bPIN[:\s-]*\d{4,6}\b", 0.85)], ["pin", "code", "secret", "security"]),
    ("CVV", [(r"\bCVV[:\s]*\d{3,4}\b", 0.9)], ["cvv", "cvc", "security", "card"]),
    ("MAC_ADDRESS", [
        (r"\b([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b", 0.9),
        (r"\b([0-9a-fA-F]{2}-){5}[0-9a-fA-F]{2}\b", 0.9),
    ], ["mac", "address", "network", "device"]),
    ("ACCOUNT_NUMBER", [
        (r"\bACCT?[-_]?\d{6,12}\b", 0.8),
        (r"\b\d{8,12}\b", 0.4),
    ], ["account", "number", "bank", "routing"]),
    ("MEDICAL_RECORD", [
        (r"\b[A-Z]\d{2}(?:\.\d{1,4})?\b", 0.6),
        (r"\bMRN[:\s-]*\d{6,10}\b", 0.9),
    ], ["diagnosis", "medical", "icd", "record", "patient", "health"]),
    ("NAME_PREFIX", [
        (r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam|Lord|Lady)\.\s*", 0.85),
        (r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam)(?=\s+[A-Z])", 0.8),
        (r"\b(?:Mr\.|Mrs\.|Ms\.|Miss\b|Dr\.|Prof\.)\b", 0.75),
    ], ["name", "title", "prefix", "salutation"]),
    ("USERNAME", [
        (r"\b[A-Za-z][A-Za-z0-9]*_[A-Za-z][A-Za-z0-9]*\b", 0.6),
        (r"\b(?:user(?:name)?|login)[:\s]+([A-Za-z0-9_-]+)\b", 0.8),
    ], ["user", "username", "login", "account"]),
    ("PASSWORD", [
        (r"\b(?:password|pass|pwd)[:\s]+([A-Za-z0-9!@#$%^&*()_+-=]+)\b", 0.9),
        (r"\b(?:[A-Za-z]+[0-9]+[A-Za-z0-9]*|[0-9]+[A-Za-z]+[A-Za-z0-9]*){8,}\b", 0.5),
    ], ["password", "secret", "credential", "pwd", "pass"]),
    ("AGE", [
        (r"\b(\d{1,3})\s*(?:years?\s*old|y\.?o\.?)\b", 0.8),
        (r"\bage[:\s]+(\d{1,3})\b", 0.9),
    ], ["age", "old", "birth", "year"]),
    ("HEIGHT", [
        (r"\b\d{2,3}\s*(?:cm|centimeters?)\b", 0.85),
        (r"\b\d['′]\s*\d{1,2}[\"″]?\b", 0.85),
        (r"\b\d+\s*feet\s*\d+\s*inches\b", 0.95),
        (r"\bheight[:\s]+\d+", 0.95),
    ], ["height", "tall", "measure", "cm", "feet", "inches", "stature"]),
    ("EYE_COLOR", [
        (r"\b(?:eye\s*color[:\s]*)?(?:brown|blue|green|hazel|gray|grey|amber|black)\b", 0.6),
        (r"\bEye\s*color[:\s]*\w+\b", 0.9),
    ], ["eye", "color", "eyes", "physical"]),
    ("GENDER", [
        (r"\b(?:gender|sex)[:\s]*(?:male|female|m|f|intersex|non-binary|other|cisgender|transgender)\b", 0.95),
        (r"\b(?:Intersex\s*person|Trans(?:gender)?\s*(?:man|woman)?|Two-?spirit|Agender|Genderfluid|Pangender)\b", 0.85),
        (r"\b(?:Male|Female|Intersex|Non-binary|Transgender|Cisgender)\b", 0.25),
    ], ["gender", "sex", "male", "female", "biological", "identity"]),
    ("JOB_INFO", [
        (r"\b(?:Senior|Junior|Lead|Chief|Head|Principal|Executive|Director|Manager|Coordinator|Specialist|Analyst|Engineer|Developer|Consultant|Officer|Administrator|Supervisor|Associate|Assistant)?\s*(?:Software|Data|Product|Project|Marketing|Sales|HR|Finance|Operations|Business|IT|Customer|Quality|Research|Engineering|Design|Development)?\s*(?:Engineer|Developer|Manager|Analyst|Designer|Coordinator|Director|Officer|Specialist|Consultant|Administrator|Architect|Orchestrator)\b", 0.8),
        (r"\b(?:Optimization|Administration|Management|Development|Design|Marketing|Sales|Operations|Engineering|Finance|Technology|Analysis|Implementation|Quality|Usability|Support|Architecture|Strategy|Planning)\b", 0.3),
        (r"\b(?:Orchestrator|Associate|Specialist|Analyst|Engineer|Developer|Manager|Director|Officer|Administrator|Coordinator|Architect|Consultant)\b", 0.3),
        (r"\b(?:job\s*title|occupation|position|job\s*area|job\s*type|works?\s+as)[:\s]+[A-Za-z\s]+\b", 0.85),
        (r"\b(?:Senior|Junior|Lead|Chief|Head|Principal)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+(?:Engineer|Developer|Manager|Director|Officer|Analyst|Architect|Consultant)\b", 0.7),
    ], ["job", "title", "position", "occupation", "work", "employment", "area", "field", "type"]),
    ("COMPANY_NAME", [
        (r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s*(?:Inc\.?|LLC|Ltd\.?|Corp\.?|Co\.?|Company|Group|Partners?|Associates?|&\s*[A-Z][A-Za-z]+)\b", 0.8),
        (r"\b[A-Z][a-z]+\s*-\s*[A-Z][a-z]+\b", 0.4),
        (r"\b(?:company|employer|organization|firm|works?\s+(?:at|for))[:\s]+[A-Z][A-Za-z\s&]+\b", 0.85),
    ], ["company", "employer", "organization", "firm", "business", "corporation"]),
    ("BUILDING_NUMBER", [(r"\b\d{1,5}(?:\s*[A-Za-z])?\b", 0.3)], ["building", "address", "number", "street", "house"]),
    ("SECONDARY_ADDRESS", [
        (r"\b(?:Apt|Apartment|Suite|Ste|Unit|Rm|Room|Floor|Fl|Bldg|Building)\.?\s*#?\d+[A-Za-z]?\b", 0.9),
    ], ["apartment", "apt", "suite", "unit", "address"]),
    ("ZIPCODE", [
        (r"\b\d{5}(?:-\d{4})?\b", 0.7),
        (r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b", 0.8),
        (r"\b[A-Z]\d[A-Z]\s*\d[A-Z]\d\b", 0.8),
    ], ["zip", "postal", "code", "postcode"]),
    ("USER_AGENT", [
        (r"Mozilla/\d+\.\d+\s*\([^)]+\)", 0.9),
        (r"\b(?:Chrome|Firefox|Safari|Edge|Opera|MSIE)/\d+", 0.8),
    ], ["user-agent", "browser", "client"]),
    ("CURRENCY", [
        (r"\b(?:USD|EUR|GBP|JPY|CNY|INR|AUD|CAD|CHF|HKD|SGD|IQD|BRL|MXN|RUB|KRW|NOK|SEK|DKK|CZK|HUF|PLN|RON|BGN|HRK|ZAR|TRY|AED|SAR|QAR|KWD|BHD|OMR|JOD|LBP|SYP|ILS|EGP|TND)\b", 0.85),
        (r"(?:[$€£¥₹₽₩₪฿₴₫]|лв|kr|Kč|USD|EUR|GBP)\s*\d+(?:[.,]\d{1,2})?", 0.85),
        (r"[₹$€£¥₽₩₪฿₴₫]", 0.8),
        (r"\b(?:лв|kr|Kč|zł|Zł)\b", 0.75),
    ], ["currency", "money", "amount", "price", "cost", "payment"]),
    ("MASKED_NUMBER", [
        (r"\b\d{4}[*X]{4,8}\d{4}\b", 0.9),
        (r"\b\d{13,19}\b", 0.5),
    ], ["card", "number", "masked", "credit", "debit"]),
    ("DIAGNOSIS", [
        (r"\b(?:COPD|CHF|CAD|DM|HTN|MI|CVA|DVT|PE|GERD|IBS|PTSD|MDD|GAD|OCD|ADHD|ASD|CKD|ESRD|HIV|AIDS|MS|RA|SLE|IBD|T1DM|T2DM)\b", 0.9),
        (r"\b(?:diagnosis|dx|diagnosed with)[:\s]+[A-Za-z\s]+\b", 0.85),
    ], ["diagnosis", "condition", "disease", "disorder", "medical"]),
    ("MEDICAL_NOTE", [
        (r"\b(?:presented\s+to|chief\s+complaint|history\s+of|physical\s+exam|assessment|treatment\s+plan|discharge\s+summary)\b", 0.7),
    ], ["patient", "medical", "note", "record", "clinical"]),
    ("CREDIT_CARD_ISSUER", [
        (r"\b(?:Visa|MasterCard|Amex|American\s*Express|Discover|Diners\s*Club|JCB|UnionPay|Maestro)\b", 0.8),
    ], ["card", "credit", "issuer", "bank"]),
    ("ACCOUNT_NAME", [
        (r"\b(?:Checking|Savings|Money\s*Market|CD|Certificate|Brokerage|IRA|401k|Retirement)\s*Account\b", 0.8),
    ], ["account", "bank", "type", "name"]),
    ("ORDINAL_DIRECTION", [
        (r"\b(?:North|South|East|West|Northeast|Northwest|Southeast|Southwest|NE|NW|SE|SW|N|S|E|W)\b", 0.5),
    ], ["direction", "compass", "heading", "location"]),
    ("LOCATION", [
        (r"\b[A-Z][a-z]+(?:\s+(?:Town|City|Village|Township|County|Parish|District))\b", 0.85),
        (r"\b(?:Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming)\b", 0.9),
        (r"\b(?:city|state|county|town|village|location)[:\s]+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", 0.85),
    ], ["location", "city", "state", "place", "town", "address", "region", "country"]),
    ("STREET", [
        (r"\b\d+\s+(?:North|South|East|West|NE|NW|SE|SW|N|S|E|W)?\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+(?:Street|Avenue|Boulevard|Drive|Road|Lane|Way|Court|Circle|Trail|Parkway|Terrace|Place|Square|Alley)\b", 0.9),
        (r"\b\d+\s+[A-Z][a-z]+\s*(?:St|Ave|Blvd|Dr|Rd|Ln|Way|Ct|Cir|Trl|Pkwy|Ter|Pl|Sq)\.\b", 0.85),
        (r"\b(?:street|address|road|avenue|boulevard|drive|lives?\s+(?:at|on))[:\s]+\d*\s*[A-Za-z\s]+\b", 0.85),
        (r"\b(?:on|at)\s+[A-Z][a-z]+\s+(?:Street|Avenue|Boulevard|Drive|Road)\b", 0.6),
    ], ["street", "address", "road", "avenue", "location", "lives"]),
    ("PHONE_NUMBER", [
        (r"\+\d{1,4}[-\s]?\d{1,4}[-\s]?\d{1,4}[-\s]?\d{1,4}", 0.85),
        (r"\+\d{3}-\d{2}\s+\d{3}\s+\d{4}", 0.9),
    ], ["phone", "tel", "mobile", "cell", "contact"]),
    ("SALARY", [
        (r"\b(?:salary|compensation|income|pay|wage|earning)[:\s]+[$€£]?\s*\d{2,3}[,.]?\d{3}\b", 0.95),
        (r"\b(?:expected|current|base|annual|yearly|monthly)\s+(?:salary|compensation|pay)[:\s]+[$€£]?\s*\d{2,3}[,.]?\d{3}\b", 0.95),
        (r"[$€£]\s*\d{2,3}[,.]?\d{3}\b", 0.85),
        (r"\b(?:earns?|makes?|paid|worth|offer(?:ed|ing)?)\s+[$€£]?\s*\d{2,3}[,.]?\d{3}\b", 0.9),
        (r"\b[1-9]\d{4,5}\b", 0.5),
        (r"\b\d{2,3}[kK]\b", 0.7),
    ], ["salary", "compensation", "pay", "income", "wage", "earning", "offer",
        "expected", "current", "annual", "base", "package", "total"]),
    ("EMPLOYEE_ID", [
        (r"\bEMP-\d{5,6}\b", 0.95),
        (r"\b(?:employee|emp)\s*(?:id|#|no|number)[:\s]*[A-Z0-9-]{5,10}\b", 0.85),
    ], ["employee", "emp", "staff", "worker", "id", "number"]),
    ("CANDIDATE_ID", [
        (r"\bCAND-\d{5,6}\b", 0.95),
        (r"\b(?:candidate|applicant)\s*(?:id|#|no|number)[:\s]*[A-Z0-9-]{5,10}\b", 0.85),
    ], ["candidate", "applicant", "interview", "hiring", "recruitment"]),
    ("BACKGROUND_CHECK", [
        (r"\b(?:background\s*check|criminal\s*(?:record|history|check)|security\s*clearance)[:\s]+[A-Za-z\s]{3,50}\b", 0.9),
        (r"\b(?:pending|ongoing|under)\s+(?:investigation|lawsuit|FBI|surveillance|criminal|legal)\b", 0.95),
        (r"\b(?:arrest(?:ed)?|conviction|felony|misdemeanor|lawsuit|harassment|fraud|embezzlement|theft)\b", 0.85),
        (r"\b(?:background|check|screening)\s*[:\s]*(?:passed|failed|clear|flagged|pending)\b", 0.9),
    ], ["background", "check", "criminal", "screening", "clearance", "investigation", "record"]),
    ("INTERNAL_NOTES", [
        (r"\b(?:internal|confidential|private|HR)\s*(?:note|comment|remark)[s]?[:\s]+.{10,100}", 0.85),
        (r"\b(?:strong|weak|excellent|poor|average)\s+(?:candidate|applicant|performer|fit)\b", 0.8),
        (r"\b(?:do\s*not|don'?t)\s+(?:hire|proceed|recommend|consider)\b", 0.95),
    ], ["internal", "note", "confidential", "private", "HR", "comment", "recommendation"]),
    ("PERFORMANCE_NOTES", [
        (r"\b(?:performance|review|evaluation)\s*(?:note|rating|score)[s]?[:\s]+.{5,100}", 0.85),
        (r"\b(?:underperform(?:ing|ance)?|poor\s*performance|needs\s*improvement|on\s*probation|PIP)\b", 0.9),
        (r"CANARY_PERF_[A-Z0-9]{8}\b", 1.0),
    ], ["performance", "review", "evaluation", "rating", "feedback", "assessment"]),
    ("DISCIPLINARY_ACTION", [
        (r"\b(?:verbal|written|final)\s+warning\s*\(\d{4}\)", 0.95),
        (r"\b(?:terminated|fired|suspended|dismissal|termination)\s*(?:for|due\s*to|because)?\s*.{0,50}", 0.9),
        (r"\b(?:disciplinary|corrective)\s+(?:action|measure|warning|notice)\b", 0.85),
    ], ["disciplinary", "warning", "termination", "suspension", "corrective"]),
    ("REFERENCE_NAME", [
        (r"\b(?:Dr|Mr|Mrs|Ms|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}(?:\s+(?:MD|PhD|DVM|JD|MBA))?\b", 0.85),
        (r"\b(?:reference|referee|recommender)[s]?[:\s]+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 0.9),
    ], ["reference", "referee", "recommendation", "contact", "former", "supervisor", "manager"]),
    ("INSURANCE_ID", [
        (r"\bINS-\d{8}\b", 0.95),
        (r"\b(?:insurance|policy)\s*(?:id|#|no|number)[:\s]*[A-Z0-9-]{6,12}\b", 0.85),
    ], ["insurance", "policy", "coverage", "health", "medical"]),
    ("CANARY_TOKEN", [
        (r"\bCANARY_[A-Z_]+_[A-Z0-9]{6,10}\b", 1.0),
        (r"\bCANARY_SSN_[A-Z0-9]{8}\b", 1.0),
        (r"\bCANARY_DIAGNOSIS_[A-Z0-9]{8}\b", 1.0),
        (r"\bCANARY_PHONE_[A-Z0-9]{8}\b", 1.0),
        (r"\bCANARY_HIRE_NOTE_[A-Z0-9]{8}\b", 1.0),
        (r"\bCANARY_CONF_NOTE_[A-Z0-9]{8}\b", 1.0),
    ], []),
]
# ---------------------------------------------------------------------------

# General entities: patterns of our own; a validator name where a checksum or
# range test decides (see functions/text.py).
GENERAL = [
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 1.0, None),
    ("CREDIT_CARD", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", 1.0, "luhn"),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 1.0, "iban"),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.85, None),
    ("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.95, "octets"),
    ("URL", r"\bhttps?://[^\s\"'<>]+", 0.85, None),
    ("DATE_TIME", r"\b\d{4}-\d{2}-\d{2}\b", 0.85, None),
]


def flat(threshold: float = 0.0, entities=None):
    """(entity, pattern number, pattern, score) for the patterns in use."""
    return [
        (entity, i, pattern, score)
        for entity, patterns, _ in RECOGNIZERS
        if entities is None or entity in entities
        for i, (pattern, score) in enumerate(patterns)
        if score >= threshold
    ]


def context_words():
    return {entity: words for entity, _, words in RECOGNIZERS}
