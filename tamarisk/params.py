"""Fixed values of the methodology, and helpers to use them as small inline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: medallion gate -------------------------------------------------
NULL_HOLD = 0.10
SMALL_TABLE_ROWS = 20
SMALL_TABLE_NULL_HOLD = 0.35
GOLD_DROP = 0.50

# ---- fixed values: column-name keywords -------------------------------------------
IDENTIFIER_KEYWORDS = (
    "id", "phone", "mobile", "national_id", "cust_id", "customer_id", "account",
    "iban", "zip", "postal", "ssn", "reference", "code", "number",
)
RESTRICTED_KEYWORDS = (
    "national_id", "ssn", "passport", "iban", "account_number",
    "credit_card", "card_number", "salary", "income",
)
CONFIDENTIAL_KEYWORDS = (
    "email", "phone", "mobile", "address", "dob", "date_of_birth", "birthdate",
    "full_name", "customer_name", "gender", "nationality",
)
PII_KEYWORDS = ("email", "phone", "national_id")
DOB_CANDIDATES = ("dob", "date_of_birth", "birth_date", "birthdate")
NAME_CANDIDATES = ("full_name", "name", "customer_name")
PHONE_CANDIDATES = ("phone", "mobile", "phone_number", "mobile_number")
ID_CANDIDATES = ("cust_id", "customer_id", "id")
NAME_THRESHOLD = 85.0

# ---- fixed values: text tokens a CSV reader takes for null --------------------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# ---- fixed values: credit-loss parameters -------------------------------------------
PD_BY_RATING = {
    "AAA": 0.0010, "AA": 0.0025, "A": 0.0060, "BBB": 0.0150, "BB": 0.0400,
    "B": 0.1000, "CCC": 0.2500, "CC": 0.3969, "C": 0.6300, "D": 1.0000,
}
DEFAULT_RATING = "B"
LGD_BY_FACILITY = {
    "تمويل عقاري": 0.25,
    "تمويل مشاريع": 0.35,
    "تمويل مركبات": 0.40,
    "تمويل تجاري": 0.45,
    "تمويل شخصي": 0.30,
    "بطاقة ائتمانية": 0.65,
}
DEFAULT_LGD = 0.55
REPORTING_DATE = "2026-08-07"
# name: (pd multiplier, lgd multiplier, probability weight)
SCENARIOS = {
    "optimistic": (0.75, 0.90, 0.25),
    "base": (1.0, 1.0, 0.55),
    "adverse": (1.5, 1.15, 0.20),
}
MODELLING_COLUMNS = ("RATING", "FACILITY_TYPE", "DPD", "ORIGINATION", "MATURITY", "EAD")

# ---- fixed values: maturity methodology ----------------------------------------------
# code, name, spec_count, operational-excellence domain
MATURITY_DOMAINS = (
    ("DG", "Data Governance", 18, False),
    ("MDC", "Metadata & Data Catalogue", 14, True),
    ("DQ", "Data Quality", 20, True),
    ("DS", "Data Storage", 12, True),
    ("CDM", "Content & Document Management", 10, False),
    ("DMD", "Data Modelling & Architecture", 8, False),
    ("DIS", "Data Integration & Sharing", 20, True),
    ("RMD", "Reference & Master Data", 15, True),
    ("BIA", "Business Intelligence & Analytics", 16, False),
    ("DVR", "Data Value Realisation", 14, False),
    ("OD", "Open Data", 8, True),
    ("FOI", "Freedom of Information", 10, False),
    ("DC", "Data Classification", 16, False),
    ("PDP", "Personal Data Protection", 10, False),
)
# code: (maturity 0-5, compliance %)
MATURITY_BASELINE = {
    "DG": (2.8, 67), "MDC": (2.0, 50), "DQ": (2.5, 60), "DS": (3.2, 75), "CDM": (2.1, 50),
    "DMD": (2.3, 50), "DIS": (2.7, 65), "RMD": (1.8, 47), "BIA": (3.0, 75), "DVR": (2.4, 57),
    "OD": (1.5, 38), "FOI": (2.0, 50), "DC": (2.6, 69), "PDP": (2.9, 70),
}
DOMAIN_WEIGHT_PCT = 7.14
PDP_WEIGHT_PCT = 7.1423
MATURITY_LEVELS = (
    (0.00, 0.24, "Capability No"), (0.25, 1.24, "Emerging"), (1.25, 2.49, "Developing"),
    (2.50, 3.99, "Defined"), (4.00, 4.74, "Managed"), (4.75, 5.00, "Leading"),
)
COMPLIANCE_HIGH, COMPLIANCE_MEDIUM = 80, 50

# ---- fixed values: compliance domains, in report order --------------------------------
COMPLIANCE_DOMAINS = (
    ("DG", "Data Governance"), ("DQ", "Data Quality"), ("DIS", "Data Integration & Sharing"),
    ("RMD", "Risk Management Data"), ("DC", "Data Classification"),
    ("PDP", "Personal Data Protection"), ("BIA", "Business Impact Assessment"), ("DS", "Data Security"),
)
UNIQUENESS_TARGET = 99.0

# ---- fixed values: stewardship, glossary, access, documents -----------------------------
STEWARD_ROLES = ("business_owner", "data_owner", "data_steward", "data_custodian", "data_consumer")
REVIEW_FREQUENCIES = ("monthly", "quarterly", "semi_annual", "annual")
TASK_STATUSES = ("open", "in_progress", "done", "cancelled")
GLOSSARY_DOMAINS = ("MDM", "Catalog", "Governance", "Security", "Banking", "Other")
POLICY_GRANTS = {
    "classification_allow": ("admin", "data_owner", "data_steward"),
    "stewardship_assign_allow": ("admin", "data_owner"),
}
DOCUMENT_EXTENSIONS = (".pdf", ".doc", ".docx")
DOCUMENT_MAX_BYTES = 10 * 1024 * 1024

# ---- fixed values: standard code lists -----------------------------------------------------
CURRENCIES = (
    ("USD", "US Dollar"), ("EUR", "Euro"), ("GBP", "Pound Sterling"), ("JPY", "Yen"), ("CHF", "Swiss Franc"),
    ("CAD", "Canadian Dollar"), ("AUD", "Australian Dollar"), ("NZD", "New Zealand Dollar"), ("CNY", "Yuan Renminbi"),
    ("HKD", "Hong Kong Dollar"), ("SGD", "Singapore Dollar"), ("INR", "Indian Rupee"), ("KRW", "Won"),
    ("SAR", "Saudi Riyal"), ("AED", "UAE Dirham"), ("QAR", "Qatari Rial"), ("KWD", "Kuwaiti Dinar"),
    ("BHD", "Bahraini Dinar"), ("OMR", "Rial Omani"), ("JOD", "Jordanian Dinar"), ("EGP", "Egyptian Pound"),
    ("TRY", "Turkish Lira"), ("ZAR", "Rand"), ("RUB", "Russian Ruble"), ("BRL", "Brazilian Real"),
    ("MXN", "Mexican Peso"), ("SEK", "Swedish Krona"), ("NOK", "Norwegian Krone"), ("DKK", "Danish Krone"),
    ("PLN", "Zloty"), ("THB", "Baht"), ("MYR", "Malaysian Ringgit"), ("IDR", "Rupiah"), ("PHP", "Philippine Peso"),
    ("PKR", "Pakistan Rupee"), ("VND", "Dong"), ("ILS", "New Israeli Sheqel"),
)
ADMIN_REGIONS = (
    ("SA-01", "Riyadh"), ("SA-02", "Makkah al Mukarramah"), ("SA-03", "Al Madinah al Munawwarah"),
    ("SA-04", "Eastern Province"), ("SA-05", "Al Qassim"), ("SA-06", "Ha'il"), ("SA-07", "Tabuk"),
    ("SA-08", "Northern Borders"), ("SA-09", "Jazan"), ("SA-10", "Najran"), ("SA-11", "Al Bahah"),
    ("SA-12", "Al Jawf"), ("SA-14", "Asir"),
)


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    return str(value)


def inline_table(spark: SparkSession, columns: str, rows) -> DataFrame:
    """A fixed handful of rows as a local relation (no job, no Python workers)."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")
