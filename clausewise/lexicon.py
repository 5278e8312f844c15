"""Vocabularies and dimension tables used as operator defaults.

Everything here is a default argument somewhere; no operator reads a module
constant directly without letting the caller override it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: levels, weights, bands -----------------------------------

LEVELS = ("user", "system", "organization")
LEVEL_WEIGHTS = {"user": 0.4, "system": 0.35, "organization": 0.25}
BANDS = ("low", "medium", "high")
PENALTY_SLOPE = 0.05
PENALTY_CAP = 0.4
HIGH_RISK_FROM = 0.67
MEDIUM_RISK_FROM = 0.34

# --- Fixed values: level classification of controls -------------------------

USER_LEVEL_WORDS = (
    "consent", "data subject", "right", "erasure", "rectification",
    "portability", "transparent", "notice", "access", "withdraw",
)
SYSTEM_LEVEL_WORDS = (
    "encryption", "integrity", "availability", "resilience", "security",
    "pseudonym", "incident", "breach", "access control", "vulnerability",
)
LEVEL_FORMULAS = {
    "user": "1 - (consent_or_rights_failures / max(total_user_events, 1))",
    "system": "1 - (security_or_safeguard_failures / max(total_system_checks, 1))",
    "organization": "1 - (governance_or_response_gaps / max(total_org_checks, 1))",
}
LEVEL_REQUIRED_FIELDS = {
    "user": ("total_user_events", "consent_or_rights_failures", "missing_user_fields"),
    "system": ("total_system_checks", "security_or_safeguard_failures", "missing_system_fields"),
    "organization": ("total_org_checks", "governance_or_response_gaps", "missing_org_fields"),
}
NORMALIZATION_RULE = "clamp(score, 0.0, 1.0)"
MISSING_DATA_RULE = "impute_with_penalty: penalty=min(0.4, 0.05*missing_fields)"

# --- Fixed values: Beta priors and indicators -------------------------------

BETA_PRIORS = {"user": (1.5, 2.5), "system": (1.4, 2.6), "organization": (1.2, 2.8)}
LEVEL_INDICATORS = {
    "user": ("consent_control", "user_access_deletion"),
    "system": ("security_controls", "tracking_controls"),
    "organization": ("collection_use", "third_party_sharing", "retention_governance"),
}

# --- Fixed values: incident-table aliases -----------------------------------

PUBLIC_FIELD_ALIASES = {
    "event_date": ("event_date", "date", "incident_date", "disclosure_date"),
    "country": ("country", "jurisdiction", "location"),
    "sector": ("sector", "industry"),
    "records_affected": ("records_affected", "affected_records", "records", "impacted_records"),
    "detection_to_response_hours": (
        "detection_to_response_hours", "response_hours", "time_to_response_hours",
    ),
    "severity": ("severity", "impact", "criticality"),
}
PUBLIC_REQUIRED_FIELDS = ("event_date", "sector", "records_affected")

# --- Fixed values: annotation categories ------------------------------------

CATEGORY_LEVELS = {
    "User Choice/Control": "user",
    "User Access, Edit and Deletion": "user",
    "Data Security": "system",
    "Do Not Track": "system",
    "First Party Collection/Use": "organization",
    "Third Party Sharing/Collection": "organization",
    "Data Retention": "organization",
    "Policy Change": "organization",
    "International and Specific Audiences": "organization",
    "Other": "organization",
}
CATEGORY_LEVELS_LOWER = {
    "user choice/control": "user",
    "choice/control": "user",
    "user access, edit and deletion": "user",
    "consent": "user",
    "user rights": "user",
    "data security": "system",
    "security": "system",
    "do not track": "system",
    "tracking technologies": "system",
    "cookies and tracking": "system",
    "first party collection/use": "organization",
    "first-party collection/use": "organization",
    "third party sharing/collection": "organization",
    "third-party sharing/collection": "organization",
    "data retention": "organization",
    "policy change": "organization",
    "international and specific audiences": "organization",
    "other": "organization",
}
CATEGORY_USER_WORDS = (
    "user", "consent", "choice", "access", "deletion", "rights", "opt out", "opt-out",
)
CATEGORY_SYSTEM_WORDS = (
    "security", "tracking", "track", "cookie", "authentication", "encryption", "safeguard",
)
CATEGORY_ORGANIZATION_WORDS = (
    "collection", "sharing", "retention", "policy", "governance",
    "third party", "third-party", "international",
)

# --- Fixed values: practice names -------------------------------------------

PRACTICE_USER_WORDS = (
    "choice", "consent", "delete", "deletion", "access", "edit",
    "opt_out", "opt-out", "optout", "rights", "request",
)
PRACTICE_SYSTEM_NAMES = (
    "SSO", "Facebook_SSO", "Contact_Password_1stParty", "Contact_Password_3rdParty",
)
PRACTICE_SYSTEM_PREFIXES = (
    "Identifier_Cookie_or_similar_Tech", "Identifier_IP_Address", "Identifier_Device_ID",
    "Identifier_Ad_ID", "Identifier_MAC", "Identifier_IMEI", "Identifier_IMSI",
    "Identifier_SIM_Serial", "Identifier_SSID_BSSID",
)
PRACTICE_ORGANIZATION_PREFIXES = (
    "Contact_", "Demographic_", "Location_", "Identifier_1stParty", "Identifier_3rdParty",
)

# --- Fixed values: field-name patterns --------------------------------------

PII_PATTERNS = (
    "name", "first_name", "last_name", "full_name", "email", "phone", "mobile",
    "address", "city", "state", "zip", "postal", "country", "dob", "birth", "ssn",
    "tax", "passport", "national_id", "driver", "ip", "cookie", "device", "location",
)
SENSITIVE_PATTERNS = (
    "health", "medical", "biometric", "genetic", "race", "ethnicity", "religion",
    "political", "sexual", "criminal", "bank", "credit_card", "card_number",
    "account_number", "salary", "income",
)

# --- Fixed values: policy checks (check_id, title, weight, keywords) --------

CHECK_SPECS = (
    ("consent_transparency", "Consent And Transparency", 12.0,
     ("consent", "opt in", "opt-out", "opt out", "permission", "notice", "transparent")),
    ("user_rights", "User Access And Deletion Rights", 12.0,
     ("access", "delete", "erasure", "right to be forgotten", "correct", "rectify",
      "portability")),
    ("security_safeguards", "Security Safeguards", 12.0,
     ("encrypt", "encryption", "security", "secure", "safeguard", "access control",
      "multi-factor")),
    ("data_retention", "Data Retention And Deletion Windows", 10.0,
     ("retention", "retain", "storage period", "delete after", "deletion schedule",
      "archive")),
    ("third_party_sharing", "Third-Party Sharing Disclosures", 10.0,
     ("third party", "third-party", "share", "vendor", "processor", "affiliate")),
    ("purpose_limitation", "Purpose Limitation", 8.0,
     ("purpose", "why we collect", "for the purpose of", "necessary",
      "legitimate interest")),
    ("incident_response", "Breach And Incident Response", 8.0,
     ("breach", "incident", "notify", "notification", "unauthorized", "compromise")),
    ("contact_and_dpo", "Contact Mechanism / DPO", 8.0,
     ("contact", "data protection officer", "dpo", "privacy team", "complaint")),
)

# --- Fixed values: built-in controls ----------------------------------------
# (check_id, regulation, control_id, title, requirement)

REGULATION_CONTROLS = (
    ("consent_transparency", "GDPR", "Article 6", "Lawfulness of processing",
     "Processing shall be lawful only if the data subject has given consent to the processing of their personal data for one or more specific purposes."),
    ("consent_transparency", "GDPR", "Article 7", "Conditions for consent",
     "The controller shall be able to demonstrate that the data subject has consented to processing of their personal data."),
    ("consent_transparency", "NIST", "CT.PO-P1", "Transparency policies",
     "Policies, processes, and procedures for transparency are established and in place to inform individuals about data processing purposes and practices."),
    ("consent_transparency", "ISO_27701", "A.7.2.3", "Determining information for consent",
     "The organisation shall determine and document the information needed for PII principals to give their consent for processing."),
    ("consent_transparency", "ISO_27701", "A.7.2.4", "Obtaining consent",
     "The organisation shall obtain and record consent from PII principals as required by applicable legislation."),
    ("user_rights", "GDPR", "Article 15", "Right of access by the data subject",
     "The data subject shall have the right to obtain confirmation as to whether personal data concerning them is being processed and access to that data."),
    ("user_rights", "GDPR", "Article 17", "Right to erasure ('right to be forgotten')",
     "The data subject shall have the right to obtain the erasure of personal data concerning them without undue delay."),
    ("user_rights", "GDPR", "Article 20", "Right to data portability",
     "The data subject shall have the right to receive personal data in a structured, commonly used and machine-readable format."),
    ("user_rights", "NIST", "CT.DM-P3", "Data access and correction",
     "Mechanisms for individuals to access, correct, and delete their personal data are in place."),
    ("user_rights", "ISO_27701", "A.7.3.2", "Determining information for PII principals",
     "The organisation shall provide PII principals with clear, accessible information about data processing and their rights."),
    ("user_rights", "ISO_27701", "A.7.3.6", "Access, correction and erasure",
     "The organisation shall implement policies and procedures to meet obligations related to PII principals' requests for access, correction, or erasure."),
    ("security_safeguards", "GDPR", "Article 32", "Security of processing",
     "The controller and processor shall implement appropriate technical and organisational measures to ensure a level of security appropriate to the risk, including encryption and access controls."),
    ("security_safeguards", "NIST", "PR.DS-P1", "Data security",
     "Data-at-rest and data-in-transit are protected using safeguards commensurate with the risk."),
    ("security_safeguards", "NIST", "PR.AC-P1", "Access control",
     "Access to data and devices is limited to authorised individuals, processes, or devices and managed consistently."),
    ("security_safeguards", "ISO_27701", "A.7.4.5", "PII de-identification and deletion at end of processing",
     "The organisation shall de-identify or delete PII at the end of processing unless there is a requirement to retain it."),
    ("data_retention", "GDPR", "Article 5.1(e)", "Storage limitation",
     "Personal data shall be kept in a form which permits identification of data subjects for no longer than is necessary for the purposes for which the data are processed."),
    ("data_retention", "NIST", "CT.DM-P7", "Data retention and disposal",
     "Retention schedules and disposal methods are established and data is disposed of according to policy."),
    ("data_retention", "ISO_27701", "A.7.4.4", "PII minimisation objectives",
     "The organisation shall define and document data minimisation objectives and retention periods."),
    ("third_party_sharing", "GDPR", "Article 28", "Processor",
     "Processing by a processor shall be governed by a contract that sets out the subject-matter and duration of the processing, the nature and purpose, and the obligations of the processor."),
    ("third_party_sharing", "NIST", "CT.PO-P4", "Third-party data sharing",
     "Policies for disclosing data processing activities to third parties including sharing, trading, and selling are established."),
    ("third_party_sharing", "ISO_27701", "A.7.5.1", "Identifying basis for PII transfer",
     "The organisation shall identify and document the relevant basis for transfers of PII to third parties."),
    ("purpose_limitation", "GDPR", "Article 5.1(b)", "Purpose limitation",
     "Personal data shall be collected for specified, explicit and legitimate purposes and not further processed in a manner incompatible with those purposes."),
    ("purpose_limitation", "NIST", "CT.PO-P2", "Purpose specification",
     "Purposes for data processing are identified and communicated to individuals."),
    ("purpose_limitation", "ISO_27701", "A.7.2.1", "Identify and document purpose",
     "The organisation shall identify and document the specific purposes for which the PII will be processed."),
    ("incident_response", "GDPR", "Article 33", "Notification of a personal data breach to the supervisory authority",
     "In the case of a personal data breach, the controller shall notify the supervisory authority within 72 hours after having become aware of it."),
    ("incident_response", "GDPR", "Article 34", "Communication of a personal data breach to the data subject",
     "When the breach is likely to result in a high risk to the rights and freedoms of natural persons, the controller shall communicate the breach to the data subject without undue delay."),
    ("incident_response", "NIST", "RS.CO-P1", "Response communication",
     "Response activities are coordinated with internal and external stakeholders, including breach notifications."),
    ("incident_response", "ISO_27701", "A.7.3.9", "PII breach notification",
     "The organisation shall notify PII principals of breaches involving their PII when required by legislation or contract."),
    ("contact_and_dpo", "GDPR", "Article 37", "Designation of the data protection officer",
     "The controller and the processor shall designate a data protection officer where core activities require regular and systematic monitoring of data subjects on a large scale."),
    ("contact_and_dpo", "NIST", "GV.PO-P3", "Roles and responsibilities",
     "Roles and responsibilities for the workforce are established with respect to privacy."),
    ("contact_and_dpo", "ISO_27701", "A.7.2.8", "Records related to processing PII",
     "The organisation shall determine and maintain records necessary to demonstrate compliance with its obligations for processing PII, including contact mechanisms."),
)

# --- Fixed values: wording that signals a control ---------------------------

CONTROL_SIGNALS = {
    "Article 6": ("lawful", "legal basis", "legitimate"),
    "Article 7": ("demonstrate consent", "withdraw"),
    "Article 15": ("access", "obtain confirmation"),
    "Article 17": ("erasure", "right to be forgotten", "delete"),
    "Article 20": ("portability", "machine-readable"),
    "Article 28": ("processor", "contract", "sub-processor"),
    "Article 32": ("encrypt", "security measure", "access control"),
    "Article 33": ("notify", "72 hours", "supervisory authority"),
    "Article 34": ("communicate", "high risk", "breach"),
    "Article 37": ("data protection officer", "dpo"),
    "Article 5.1(b)": ("specified purpose", "legitimate purpose", "compatible"),
    "Article 5.1(e)": ("no longer than necessary", "storage limitation", "retention period"),
    "CT.PO-P1": ("transparency", "inform"),
    "CT.PO-P2": ("purpose", "communicated"),
    "CT.PO-P4": ("third party", "sharing", "disclosure"),
    "CT.DM-P3": ("access", "correct", "delete"),
    "CT.DM-P7": ("retention schedule", "disposal"),
    "PR.DS-P1": ("protect", "safeguard"),
    "PR.AC-P1": ("access control", "authorised"),
    "RS.CO-P1": ("response", "notification"),
    "GV.PO-P3": ("roles", "responsibilities", "privacy team"),
    "A.7.2.1": ("purpose", "documented"),
    "A.7.2.3": ("consent", "information"),
    "A.7.2.4": ("obtain consent", "record"),
    "A.7.2.8": ("records", "demonstrate compliance", "contact"),
    "A.7.3.2": ("clear", "accessible information"),
    "A.7.3.6": ("access", "correction", "erasure"),
    "A.7.3.9": ("breach notification", "notify"),
    "A.7.4.4": ("minimisation", "retention"),
    "A.7.4.5": ("de-identify", "deletion"),
    "A.7.5.1": ("transfer", "basis"),
}

# --- Fixed values: page furniture and headings of regulation texts ----------

ARTICLE_NOISE_CONTAINS = ("Official Journal of the European Union", "EN", "L 119/", "4.5.2016")
ARTICLE_NOISE_FULL = r"\(\d+\)"
SUBCATEGORY_NOISE_PREFIXES = (
    "CSWP", "NIST Privacy Framework", "April", "National Institute of Standards",
    "Table of Contents",
)
SUBCATEGORY_NOISE_FULL = r"[0-9]+"
CLAUSE_NOISE_PREFIXES = ("© ISO", "ISO/IEC")
CLAUSE_NOISE_FULL = r"[ivxlcdm]+"

# --- Fixed values: input-set sub-directories --------------------------------

ANNOTATION_INPUT_SETS = {
    "annotations": "annotations",
    "consolidation-0.5": "consolidation/threshold-0.5-overlap-similarity",
    "consolidation-0.75": "consolidation/threshold-0.75-overlap-similarity",
    "consolidation-1.0": "consolidation/threshold-1.0-overlap-similarity",
}
MIXED_INPUT_SETS = {"normalized": "normalized", "root": "."}


# --- Column and DataFrame forms ---------------------------------------------

def strings(values) -> Column:
    """ARRAY<STRING> literal; Catalyst folds it to a constant."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def checks_literal(specs=CHECK_SPECS) -> Column:
    """Checks as an array of structs, so a lookup against them stays in the row."""
    return F.array(*[
        F.struct(
            F.lit(i).alias("check_seq"),
            F.lit(check_id).alias("check_id"),
            F.lit(title).alias("check_title"),
            F.lit(float(weight)).alias("weight"),
            strings(keywords).alias("keywords"),
        )
        for i, (check_id, title, weight, keywords) in enumerate(specs)
    ])


def check_table(spark: SparkSession, specs=CHECK_SPECS) -> DataFrame:
    return spark.createDataFrame(
        [(c, t, float(w), list(k)) for c, t, w, k in specs],
        "check_id string, title string, weight double, keywords array<string>",
    )


def control_table(spark: SparkSession, controls=REGULATION_CONTROLS) -> DataFrame:
    return spark.createDataFrame(
        [tuple(row) for row in controls],
        "check_id string, regulation string, control_id string, title string, requirement string",
    )


def signal_table(spark: SparkSession, signals=None) -> DataFrame:
    signals = CONTROL_SIGNALS if signals is None else signals
    return spark.createDataFrame(
        [(k, list(v)) for k, v in signals.items()], "control_id string, signals array<string>"
    )
