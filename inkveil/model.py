"""Schemas and fixed tables: personal-data types, legal actions, rule texts, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names, legal pairs, descriptions, defaults, limits and rule
# texts that results depend on.
# ---------------------------------------------------------------------------

PII_TYPES = [
    "person_name",
    "email",
    "phone",
    "company",
    "address",
    "financial",
    "id_numbers",
    "date_of_birth",
]

ACTIONS = ["delete", "invent", "keep_part"]

# (pii_type, action, description)
VALID_ACTIONS = [
    ("person_name", "delete", "Remove name completely, replace with [NAME_REMOVED]"),
    ("person_name", "invent", "Replace with consistent synthetic name"),
    ("person_name", "keep_part", "Keep first name only, number duplicates (e.g., John 1, John 2)"),
    ("email", "delete", "Remove email completely, replace with [EMAIL_REMOVED]"),
    ("email", "keep_part", "Keep domain only (e.g., [EMAIL_REDACTED]@company.com)"),
    ("phone", "delete", "Remove phone completely, replace with [PHONE_REMOVED]"),
    ("phone", "invent", "Replace with synthetic phone number"),
    ("phone", "keep_part", "Keep country/area code only (e.g., +1 (555) [REDACTED])"),
    ("company", "keep_part", "Keep company name as-is"),
    ("company", "invent", "Replace with consistent synthetic company name"),
    ("address", "delete", "Remove address completely, replace with [ADDRESS_REMOVED]"),
    ("address", "invent", "Replace with synthetic address"),
    ("financial", "delete", "Remove financial data, replace with [FINANCIAL_REMOVED]"),
    ("financial", "invent", "Replace with synthetic financial data"),
    ("id_numbers", "delete", "Remove ID numbers, replace with [ID_REMOVED]"),
    ("id_numbers", "invent", "Replace with synthetic ID numbers"),
    ("date_of_birth", "delete", "Remove date of birth, replace with [DOB_REMOVED]"),
    ("date_of_birth", "invent", "Replace with synthetic date of birth"),
]

DEFAULT_ACTIONS = {
    "person_name": "keep_part",
    "email": "keep_part",
    "phone": "delete",
    "company": "keep_part",
    "address": "delete",
    "financial": "delete",
    "id_numbers": "delete",
    "date_of_birth": "delete",
}

REMOVED = {
    "person_name": "[NAME_REMOVED]",
    "email": "[EMAIL_REMOVED]",
    "phone": "[PHONE_REMOVED]",
    "company": "",
    "address": "[ADDRESS_REMOVED]",
    "financial": "[FINANCIAL_REMOVED]",
    "id_numbers": "[ID_REMOVED]",
    "date_of_birth": "[DOB_REMOVED]",
}

# (extension, source_type)
FORMATS = [
    (".txt", "text"),
    (".docx", "docx"),
    (".pdf", "pdf"),
    (".xlsx", "excel"),
    (".xls", "excel"),
    (".csv", "csv"),
    (".eml", "email"),
]

MAX_BYTES = 10 * 1024 * 1024
UPLOAD_TTL_SECONDS = 300
PROFILE_NAME_MAX = 50

NAME_EMPTY = "Profile name cannot be empty"
NAME_TOO_LONG = "Profile name must be 50 characters or less"
NAME_BAD_CHARS = "Profile name must contain only letters, numbers, underscores, and hyphens"

MODEL_OPTIONS = {"temperature": 0.1, "top_p": 0.9, "num_predict": 8192}

# (pii_type, action, text); a prompt holds one text per type, in type order.
RULE_TEXTS = [
    ("person_name", "delete", """### Person Names (DELETE)
- Remove ALL person names completely
- Replace with: [NAME_REMOVED]
- Examples:
  - "John Smith sent the email" → "[NAME_REMOVED] sent the email"
  - "Contact Sarah Johnson" → "Contact [NAME_REMOVED]"
"""),
    ("person_name", "invent", """### Person Names (INVENT)
- Replace ALL person names with consistent synthetic names
- IMPORTANT: Same original name = same invented name throughout
- Examples:
  - "John Smith" → "Alex Chen" (all occurrences)
  - "Sarah Johnson" → "Maria Garcia" (all occurrences)
- Keep the invented names realistic and professional
"""),
    ("person_name", "keep_part", """### Person Names (KEEP_PART)
- Keep ONLY the first name
- Drop middle names and last names completely
- Number duplicate first names sequentially
- Examples:
  - "John Michael Smith" → "John 1"
  - "John Andrew Davis" (different person) → "John 2"
  - "Sarah Johnson" → "Sarah 1"
- Track which original person maps to which number for consistency
"""),
    ("email", "delete", """### Email Addresses (DELETE)
- Remove ALL email addresses completely
- Replace with: [EMAIL_REMOVED]
- Examples:
  - "Contact john.smith@company.com" → "Contact [EMAIL_REMOVED]"
"""),
    ("email", "keep_part", """### Email Addresses (KEEP_PART)
- Keep the domain name only
- Remove the local part (before @)
- Format: [EMAIL_REDACTED]@domain.com
- Examples:
  - "john.smith@company.com" → "[EMAIL_REDACTED]@company.com"
  - "ceo@example.org" → "[EMAIL_REDACTED]@example.org"
"""),
    ("phone", "delete", """### Phone Numbers (DELETE)
- Remove ALL phone numbers completely
- Replace with: [PHONE_REMOVED]
- Match all formats: international, local, with/without spaces/dashes
- Examples:
  - "+1 (555) 123-4567" → "[PHONE_REMOVED]"
  - "555.123.4567" → "[PHONE_REMOVED]"
"""),
    ("phone", "invent", """### Phone Numbers (INVENT)
- Replace with synthetic phone numbers
- Maintain the same format and country/area code style
- Examples:
  - "+1 (555) 123-4567" → "+1 (555) 987-6543"
  - "+61 2 1234 5678" → "+61 2 8765 4321"
"""),
    ("phone", "keep_part", """### Phone Numbers (KEEP_PART)
- Keep country code and area code only
- Remove remaining digits
- Format: +XX (XX) [REDACTED]
- Examples:
  - "+1 (555) 123-4567" → "+1 (555) [REDACTED]"
  - "+61 2 1234 5678" → "+61 (2) [REDACTED]"
"""),
    ("company", "keep_part", """### Company Names (KEEP_PART)
- Keep company names exactly as-is
- No modification needed
- Distinguish companies from person names using context
"""),
    ("company", "invent", """### Company Names (INVENT)
- Replace company names with consistent synthetic names
- IMPORTANT: Same original company = same invented name throughout
- Examples:
  - "Acme Corp" → "TechFlow Industries" (all occurrences)
  - "Google" → "DataSphere Inc" (all occurrences)
- Keep invented names realistic and business-appropriate
"""),
    ("address", "delete", """### Physical Addresses (DELETE)
- Remove ALL physical addresses completely
- Replace with: [ADDRESS_REMOVED]
- Match street addresses, PO boxes, city/state/zip combinations
- Examples:
  - "123 Main St, New York, NY 10001" → "[ADDRESS_REMOVED]"
  - "PO Box 456, Seattle WA" → "[ADDRESS_REMOVED]"
"""),
    ("address", "invent", """### Physical Addresses (INVENT)
- Replace with synthetic addresses
- Maintain same format and general location type
- Examples:
  - "123 Main St, New York, NY 10001" → "456 Oak Ave, Chicago, IL 60601"
  - Keep consistency if same address appears multiple times
"""),
    ("financial", "delete", """### Financial Data (DELETE)
- Remove ALL financial data completely
- This includes: account numbers, credit card numbers, bank details, specific monetary amounts tied to individuals
- Replace with: [FINANCIAL_REMOVED]
- Note: General business figures or statistics may be kept unless tied to specific individuals
"""),
    ("financial", "invent", """### Financial Data (INVENT)
- Replace financial data with synthetic values
- Maintain same format (e.g., 16-digit card numbers, account number patterns)
- For amounts, use similar order of magnitude
"""),
    ("id_numbers", "delete", """### ID Numbers (DELETE)
- Remove ALL identification numbers completely
- This includes: employee IDs, customer IDs, SSN/TFN, passport numbers, driver's license numbers
- Replace with: [ID_REMOVED]
"""),
    ("id_numbers", "invent", """### ID Numbers (INVENT)
- Replace ID numbers with synthetic values
- Maintain same format and length
- Examples:
  - "EMP-12345" → "EMP-67890"
  - SSN format "123-45-6789" → "987-65-4321"
"""),
    ("date_of_birth", "delete", """### Dates of Birth (DELETE)
- Remove ALL dates of birth completely
- Replace with: [DOB_REMOVED]
- Look for context clues like "born on", "DOB:", "birthday", age calculations
"""),
    ("date_of_birth", "invent", """### Dates of Birth (INVENT)
- Replace with synthetic dates
- Maintain reasonable age range based on context
- Keep same date format as original
"""),
]

PROMPT_HEAD = """You are a document sanitization expert. Your task is to process the following document and remove or transform personally identifiable information (PII) according to the specific rules provided.

## CRITICAL INSTRUCTIONS

1. **Preserve Document Structure**: Maintain all headings, tables, lists, and formatting exactly as they appear.
2. **Consistency**: If the same entity (person, company, etc.) appears multiple times, use the SAME replacement throughout the entire document.
3. **Context Awareness**: Use context to identify PII that may not follow standard formats.
4. **Output Format**: Return ONLY the sanitized document content. Do not include explanations or metadata.

## PII HANDLING RULES

"""

PROMPT_MIDDLE = """

## ENTITY TRACKING

You MUST track entities to ensure consistency:
- If "John Smith" appears 5 times and the rule is KEEP_PART, all 5 instances must become "John 1"
- If a second person named "John Davis" appears, they become "John 2"
- If the rule is INVENT, invent ONE replacement name and use it for ALL occurrences

## DOCUMENT TO SANITIZE

"""

PROMPT_TAIL = """

## OUTPUT

Return the sanitized document below. Preserve all formatting (markdown headers, tables, lists, etc.):
"""

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

PIECE_TYPE = "struct<pii_type:string,rule:string,value:string>"
SPAN_TYPE = "struct<pii_type:string,rule:string,start:int,end:int,value:string,prio:int>"

# Columns every extractor returns, in this order.
DOCUMENT_COLUMNS = [
    "doc_id", "filename", "source_type", "content", "page_count", "sheet_count", "sheets",
    "row_count", "column_count", "subject", "sender", "sent_date", "error_code", "error",
]

DOCUMENT_TYPES = {
    "doc_id": "string",
    "filename": "string",
    "source_type": "string",
    "content": "string",
    "page_count": "int",
    "sheet_count": "int",
    "sheets": "array<string>",
    "row_count": "int",
    "column_count": "int",
    "subject": "string",
    "sender": "string",
    "sent_date": "string",
    "error_code": "string",
    "error": "string",
}

PROFILE_JSON_SCHEMA = T.StructType([
    T.StructField("profiles", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("modified_at", T.StringType()),
        T.StructField("config", T.StructType([
            T.StructField(t, T.StructType([
                T.StructField("action", T.StringType()),
                T.StructField("description", T.StringType()),
            ])) for t in PII_TYPES
        ])),
    ]))),
    T.StructField("next_id", T.IntegerType()),
])


def document_columns(df: DataFrame) -> DataFrame:
    """Project to the document schema; columns the source lacks become null."""
    have = set(df.columns)
    return df.select([
        (F.col(c) if c in have else F.lit(None)).cast(DOCUMENT_TYPES[c]).alias(c)
        for c in DOCUMENT_COLUMNS
    ])


# ---------------------------------------------------------------------------
# Fixed tables (at most 18 rows each, so a broadcast of them is bounded)
# ---------------------------------------------------------------------------

def pii_types(spark: SparkSession) -> DataFrame:
    """8 rows (pii_type, ord)."""
    return spark.createDataFrame(list(zip(PII_TYPES, range(1, 9))), "pii_type string, ord int")


def valid_actions(spark: SparkSession) -> DataFrame:
    """18 legal (pii_type, action, description) rows."""
    return spark.createDataFrame(VALID_ACTIONS, "pii_type string, action string, description string")


def rule_texts(spark: SparkSession) -> DataFrame:
    """18 (pii_type, action, rule_text) rows used to build prompts."""
    return spark.createDataFrame(RULE_TEXTS, "pii_type string, action string, rule_text string")


def formats(spark: SparkSession) -> DataFrame:
    """7 supported (ext, source_type) rows."""
    return spark.createDataFrame(FORMATS, "ext string, source_type string")


def type_order(pii_type: Column) -> Column:
    """1..8 position of a type; null for an unknown type."""
    pos = F.array_position(F.array([F.lit(t) for t in PII_TYPES]), pii_type)
    return F.when(pos > 0, pos.cast("int"))


def action_is_legal(pii_type: Column, action: Column) -> Column:
    return F.concat_ws("=", pii_type, action).isin([f"{t}={a}" for t, a, _ in VALID_ACTIONS])
