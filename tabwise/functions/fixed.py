"""Fixed values.

Every word list, pattern, threshold and format below must keep exactly this value
for results to agree with the behaviour being matched; none of it is tuning.
"""

# --- missing values -------------------------------------------------------
NA_TOKENS = [
    "", "NA", "N/A", "n/a", "NULL", "null", "NaN", "nan", "None", "#N/A", "#NA", "<NA>",
    "-nan", "-NaN", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN", "#N/A N/A",
]

# --- logical types --------------------------------------------------------
BOOL_TRUE = ["true", "1", "yes", "t", "y"]
BOOL_FALSE = ["false", "0", "no", "f", "n"]
DATE_LIKE = r"^\s*(\d{1,4})[./\-](\d{1,2})[./\-](\d{1,4})(?:\s+\d{1,2}:\d{1,2}(?::\d{1,2})?)?\s*$"
DATE_PARTS = r"^\s*(\d{1,4})([./\-])(\d{1,4})\2(\d{1,4})(?:\s+\d{1,2}:\d{1,2}(?::\d{1,2})?)?\s*$"
CURRENCY_SIGNS = "$€£₹¥"
NUMBER_NOISE = r"[$€£₹¥%,]"

# Sizes of the leading samples used when sampling is asked for.
SAMPLE_TYPE_ROWS = 30
SAMPLE_PII_ROWS = 50
SAMPLE_LABEL_ROWS = 40
SAMPLE_DATE_ROWS = 100

# --- dates ----------------------------------------------------------------
DATE_PATTERNS = {
    "DD/MM/YYYY": "d/M/yyyy",
    "DD-MM-YYYY": "d-M-yyyy",
    "DD.MM.YYYY": "d.M.yyyy",
    "MM/DD/YYYY": "M/d/yyyy",
    "MM-DD-YYYY": "M-d-yyyy",
    "MM.DD.YYYY": "M.d.yyyy",
    "YYYY/MM/DD": "yyyy/M/d",
    "YYYY-MM-DD": "yyyy-M-d",
    "YYYY.MM.DD": "yyyy.M.d",
}
LOCALE_HEADERS = ["country", "locale", "nation", "location"]
LOCALE_FORMATS = {
    "us": "MM/DD/YYYY",
    "usa": "MM/DD/YYYY",
    "united states": "MM/DD/YYYY",
    "uk": "DD/MM/YYYY",
    "united kingdom": "DD/MM/YYYY",
    "great britain": "DD/MM/YYYY",
    "india": "DD/MM/YYYY",
    "in": "DD/MM/YYYY",
    "australia": "DD/MM/YYYY",
    "au": "DD/MM/YYYY",
    "canada": "YYYY-MM-DD",
    "germany": "DD.MM.YYYY",
    "de": "DD.MM.YYYY",
    "france": "DD/MM/YYYY",
    "fr": "DD/MM/YYYY",
}

# --- personal data --------------------------------------------------------
_PERSON = (
    "full_?name|first_?name|last_?name|customer_?name|patient_?name|employee_?name|"
    "user_?name|client_?name|fname|lname|name"
)
PII_HEADER_RULES = [
    ("email", r"(?i)(email|e_mail|mail_address|mail)"),
    ("phone", r"(?i)(phone|mobile|cell|telephone|contact_num|contact_no)"),
    ("ssn_national_id", r"(?i)(ssn|social_security|national_id|aadhaar|pan_card|tax_id)"),
    ("credit_card", r"(?i)(credit_card|card_num|cc_num|debit_card|card_no)"),
    ("name", rf"(?i)^({_PERSON})$"),
    ("address", r"(?i)(address|street|addr|street_address|home_address|postal_code|zip_code|zipcode)"),
]
EMAIL_VALUE = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE_VALUE = r"^(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$"
CARD_VALUE = r"^(?:\d{4}[-\s]?){3}\d{4}$"
SSN_VALUE = r"^\d{3}-\d{2}-\d{4}$"
NATIONAL_12_VALUE = r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}$"
UUID_VALUE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
CURRENCY_VALUE = r"[$€£₹¥]"
PII_VALUE_SHARE = 0.50

# Word-bounded search forms; (?U) gives Unicode word boundaries.
EMAIL_SEARCH = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_SEARCH = r"(?U)\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
CARD_SEARCH = r"(?U)\b(?:\d{4}[-\s]?){3}\d{4}\b"
SSN_SEARCH = r"(?U)\b\d{3}-\d{2}-\d{4}\b"

SECRET_PAIR = r"(?i)(api[_-]?key|secret|password|token|bearer)\s*[:=]\s*['\"]?([a-zA-Z0-9_\-\.]{8,})['\"]?"
SECRET_KEY = r"sk-[a-zA-Z0-9]{20,48}"

# --- semantic labels ------------------------------------------------------
LABEL_RULES = [
    ("identifier", r"(?i)^(id|uuid|guid|_id|id_|key|code|sku|order_id|customer_id|patient_id|user_id|emp_id|transaction_id)$"),
    ("identifier", r"(?i)(_id|id_|account_num|account_no|acc_num|acc_no|tracking_num)"),
    ("email", r"(?i)(email|e_mail|mail)"),
    ("phone", r"(?i)(phone|mobile|cell|telephone|fax)"),
    ("person_name", r"(?i)^(full_?name|first_?name|last_?name|customer_?name|patient_?name|client_?name|user_?name|name)$"),
    ("geographic", r"(?i)(address|street|zip|postal|city|state|country|region|lat|latitude|lon|longitude)"),
    ("date_of_birth", r"(?i)(dob|birth|birthday|date_of_birth)"),
    ("currency_amount", r"(?i)(revenue|sales|income|salary|wage|price|cost|amount|amt|spend|budget|balance|fare|fee|total_amt|gross|profit)"),
    ("financial_metric", r"(?i)(account_balance|loan_amount|credit_score|debt|mortgage)"),
    ("target_label", r"(?i)^(churn|churned|is_churn|target|label|outcome|class|status|approved|default|defaulted|fraud|is_fraud|purchased|converted)$"),
    ("age", r"(?i)^(age|years_old|age_years)$"),
    ("gender", r"(?i)(gender|sex)"),
    ("quantity", r"(?i)(quantity|qty|units|count|volume)"),
    ("percentage", r"(?i)(discount|discount_pct|rate|tax|percentage|pct|margin)"),
    ("score", r"(?i)(rating|score|stars|review_score|satisfaction)"),
    ("health_metric", r"(?i)(blood_pressure|bp|diagnosis|heart_rate|pulse|treatment|glucose|insulin|bmi|symptom)"),
]
OUTCOME_LABELS = ["target_label", "churn", "default", "status", "outcome"]

# --- domains --------------------------------------------------------------
DOMAIN_KEYWORDS = {
    "retail": [
        "revenue", "sales", "sku", "customer_id", "order_date", "price", "quantity", "discount",
        "product", "store", "inventory", "cart", "item", "unit_price", "orders", "purchased",
    ],
    "healthcare": [
        "blood_pressure", "diagnosis", "patient_id", "heart_rate", "pulse", "glucose", "insulin",
        "bmi", "treatment", "symptom", "dosage", "disease", "medical", "doctor", "hospital",
        "health_metric",
    ],
    "finance": [
        "account_balance", "transaction_id", "loan_amount", "interest_rate", "credit_score",
        "default", "financial_metric", "balance", "debt", "mortgage", "credit_limit", "assets",
        "liabilities", "loan_status",
    ],
}

# --- modelling ------------------------------------------------------------
TARGET_WORDS = [
    "default", "churn", "target", "label", "status", "outcome", "fraud", "class", "response",
    "purchased", "approved",
]
POST_OUTCOME = [
    r"cancel.*date", r"cancellation", r"discharge.*date", r"outcome.*note", r"resolved.*flag",
    r"resolution.*date", r"churn.*date", r"termination.*date", r"exit.*date",
]
LEAKAGE_LIMIT = 0.95
MIN_MODEL_ROWS = 30
MIN_CLASS_ROWS = 5

# --- questions ------------------------------------------------------------
OPERATIONS = [
    "mean", "sum", "count", "min", "max", "value_counts", "groupby_mean", "median", "std",
    "variance", "groupby_sum",
]
SHIELD_LABELS = [
    "identifier", "name", "person_name", "email", "phone", "ssn_national_id", "national_id",
    "credit_card", "address", "date_of_birth",
]
SHIELD_HEADERS = [
    r"(?i)(^(id|uuid|guid|_id|id_|key|code|sku|order_id|customer_id|patient_id|user_id|emp_id|employee_id|transaction_id)$"
    r"|(_id$|^id_|account_num|account_no|acc_num|acc_no|tracking_num|client_id))",
    rf"(?i)^({_PERSON})$",
    r"(?i)(email|e_mail|mail_address|mail)",
    r"(?i)(phone|mobile|cell|telephone|contact_num|contact_no|fax)",
    r"(?i)(ssn|social_security|national_id|aadhaar|pan_card|tax_id|passport)",
    r"(?i)(credit_card|card_num|cc_num|debit_card|card_no|account_number)",
    r"(?i)(address|street|addr|street_address|home_address|postal_code|zip_code|zipcode)",
    r"(?i)(dob|birth|birthday|date_of_birth)",
]
EVIDENCE_LABELS = ["identifier", "person_name", "email", "phone", "credit_card", "ssn_national_id", "address"]
EVIDENCE_HEADER = (
    rf"(?i)^({_PERSON}|email|e_mail|mail|phone|mobile|cell|telephone|contact_num|contact_no|ssn|"
    r"social_security|national_id|aadhaar|pan_card|tax_id|credit_card|card_num|cc_num|debit_card|card_no|"
    r"address|street|addr|street_address|home_address|postal_code|zip_code|zipcode|customer_?id|user_?id|"
    r"client_?id|patient_?id|account_?id|employee_?id|ssn_?id)$"
)
MESSAGE_SCREEN = [
    ("ignore_instructions", r"\bignore\s+(?:all\s+)?(?:previous\s+)?instructions\b"),
    ("ignore_safety", r"\bignore\s+(?:the\s+)?safety\s+rules\b"),
    ("hidden_prompt", r"\b(?:system\s+prompt|hidden\s+prompt|hidden\s+instructions?|secret\s+instructions?)\b"),
    ("show_people", r"\b(?:print\s*\(\s*df|show\s+(?:all\s+)?(?:patient|customer|client|user)s?\s*(?:names?|emails?|phone|ssn|credit\s*card|data|info|record|details?)?)\b"),
    ("code_fragment", r"(?:\bexec\s*\(|\beval\s*\(|\bimport\s+os|\bos\.system|\bsubprocess|__import__|pd\.eval|pandas\.eval|\.query\s*\(|\bselect\s+.+\s+from\b|\bdrop\s+table\b|\binsert\s+into\b|\bdelete\s+from\b)"),
    ("reveal_raw", r"\b(?:give\s+me|reveal|dump)\s+(?:the\s+)?(?:prompt|instructions|secret|dataframe|data\s*frame|dataset|raw\s+data)\b"),
    ("list_people", r"\b(?:what\s+are\s+(?:all\s+)?(?:the\s+)?|list\s+all|show\s+all|display\s+all|print\s+all|get\s+all|extract\s+all)\s+(?:emails?|names?|phones?|ssns?|addresses?|customers?|patients?|users?|records?)\b"),
]

# --- numbers in claims ----------------------------------------------------
SCALE_SUFFIX = r"(?U)(?:/|\bout of\s+)\s*100\b"
NUMBER = r"(?U)[-+]?\b\d+(?:,\d{3})*(?:\.\d+)?%?\b"
CLAIM_CATEGORIES = ["correlation", "distribution", "machine_learning", "quality"]

# --- files ----------------------------------------------------------------
DELIMITERS = [",", "\t", ";", "|"]
FILE_SIGNATURES = [
    ("4D5A", "Windows Executable (PE/EXE/DLL)"),
    ("7F454C46", "Linux Executable (ELF)"),
    ("25504446", "PDF Document"),
    ("89504E470D0A1A0A", "PNG Image"),
    ("FFD8FF", "JPEG Image"),
    ("474946383761", "GIF Image"),
    ("474946383961", "GIF Image"),
]
ZIP_SIGNATURE = "504B0304"

# What the audit of a file says, word for word.
AUDIT = {
    "empty": "File is empty (0 bytes).",
    "large": "Dataset too large for this version (maximum {}MB).",
    "legacy": "Legacy .xls format is unsupported.",
    "extension": "Unsupported file extension '%s'.",
    "not_zip": "Content sniffing failed: .xlsx file is not a valid OpenXML Zip archive.",
    "broken_zip": "Corrupted .xlsx file: unable to read zip structure.",
    "no_parts": "Invalid Excel structure: missing '[Content_Types].xml' or 'xl/' folder in .xlsx.",
    "signature": "Content sniffing failed: file has .csv extension but signature matches %s.",
    "no_text": "Dataset contains no parseable text.",
    "no_rows": "Dataset contains zero parseable rows.",
    "header_only": "Dataset contains no data rows (zero rows).",
}

# Number formats of workbooks that show a date, and those that show a time of day.
DATE_FORMAT_IDS = [14, 15, 16, 17, 22, 27, 28, 29, 30, 31, 34, 35, 36, 50, 51, 52, 53, 54, 55, 56, 57, 58]
TIME_FORMAT_IDS = [18, 19, 20, 21, 32, 33, 45, 47]

# Sentences of logs, insights, answers and refusals, word for word.
SAYS = {
    "classifier_score": "Machine learning classification model (%s) achieved an F1 score of %.2f (Accuracy: %.1f%%) predicting target column '%s'.",
    "regressor_score": "Machine learning regression model (%s) achieved an RMSE of %.2f with an R² score of %.2f predicting target column '%s'.",
    "driver": "Primary predictive driver is '%s' with a relative feature importance of %.1f%%.",
    "correlation": "Detected a %s %s linear correlation of %.2f between '%s' and '%s'.",
    "leader": "Column '%s' has %d unique categories, led by '%s' with %d occurrences (%.1f%% of total).",
    "size": "Analyzed dataset of %d rows and %d columns with an overall data quality score of %d/100.",
    "truncated": "\n\n[Context truncated to token budget]",
    "no_anomalies": "No major anomalies flagged.",
    "no_defects": "No major defects.",
    "quality_answer": "The dataset has an overall data quality score of %d/100. Key issues identified: %s",
    "domain_answer": "The detected domain for this dataset is %s (confidence: %.1f%%).",
    "shape_answer": "The dataset contains %d rows and %d columns.",
    "too_few_rows": "Machine learning training was safely skipped due to insufficient data rows.",
    "no_target": "Machine learning was skipped because no suitable prediction target column was identified.",
    "no_insights": "No executive insights were generated for this dataset.",
    "no_candidates": "No target candidate columns were flagged in this dataset.",
    "date_limit": "Temporal Ambiguity: Date column '%s' contained ambiguous formats and was preserved in raw format.",
    "insight_limit": "Business Insights: Limited numerical signal was available in the dataset to extract high-confidence business insights.",
    "empty_text": "Empty insight text",
    "no_numbers": "Insight contains zero numbers (unquantifiable claim)",
    "ungrounded": "Ungrounded numerical claim(s) detected: [",
    "no_category": "Missing or empty 'category' field",
    "no_text": "Missing or empty 'text' field",
    "no_evidence": "Missing or empty 'evidence' field",
    "no_recommendation": "Missing or empty 'recommendation' field",
    "ambiguous_date": "Date format is ambiguous and requires user confirmation; preserved raw values unchanged.",
    "all_missing": "all values missing, filled with 0.0",
    "copies_removed": "Removed {} exact duplicate rows",
    "date_normalized": "Normalized date format from '{}' to ISO 'YYYY-MM-DD'",
    "median_chosen": "distribution skew = {:.2f} (|skew| > 1), median chosen over mean",
    "mean_chosen": "distribution skew = {:.2f} (|skew| <= 1), mean chosen",
    "mode_used": "missing percentage = {:.1f}% (<= 30%), mode '{}' used",
    "unknown_used": "missing percentage = {:.1f}% (> 30% or no valid mode), 'Unknown' assigned",
    "outliers_flagged": "IQR outlier detection: [{:.2f}, {:.2f}] (retained and flagged)",
}
