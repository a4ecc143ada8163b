"""Fixed values of the data model: closed vocabularies, limits, word lists and patterns.

Everything in this file must equal the values the analysed corpus uses; nothing here is logic.
"""

# --- fixed values: status words -> normalised conclusion -------------------------------------
STATUS_ALIASES = {
    "available": "available",
    "agreed": "agreed",
    "approved": "approved",
    "endorsed": "endorsed",
    "merged": "merged",
    "not pursued": "not_pursued",
    "not treated": "not_treated",
    "not handled": "not_treated",
    "noted": "noted",
    "postponed": "postponed",
    "reissued": "reissued",
    "rejected": "rejected",
    "reserved": "reserved",
    "revised": "revised",
    "withdrawn": "withdrawn",
}
UNKNOWN_STATUS = "unknown"
DECISION_STATUSES = ("agreed", "approved", "rejected", "not_pursued", "postponed", "revised")
NO_ARCHIVE_STATUSES = ("reserved", "withdrawn", "revised", "not_pursued")

# --- fixed values: evidence authority ---------------------------------------------------------
AUTHORITY_RANK = {
    "approved_report": 100,
    "final_report": 90,
    "meeting_export": 80,
    "draft_report": 70,
    "tdoc_body": 60,
    "model_inference": 10,
}

# --- fixed values: block, artifact, edge and dataset vocabularies --------------------------------
SETTLED_PARSE_STATUSES = ("parsed", "quarantined", "not_applicable")

# --- fixed values: spreadsheet vocabulary ----------------------------------------------------
PRIVATE_SHEETS = ("registration", "voting list", "cc_attendees", "meeting_admin")
COLUMN_ALIASES = {
    "td_": "tdoc",
    "tdoc_": "tdoc",
    "tdoc_number": "tdoc",
    "doc_for": "for",
    "result": "tdoc_status",
    "rel": "release",
    "specification": "spec",
    "work_item": "related_wis",
    "workitem": "related_wis",
    "wi": "related_wis",
    "cr_": "cr",
    "rev": "cr_revision",
    "cat": "cr_category",
}
DOCUMENT_ID_PREFIXES = ("R2-", "R3-", "S2-", "C1-")

# --- fixed values: organisation names -------------------------------------------------------
CORPORATE_SUFFIXES = ("inc", "inc.", "ltd", "ltd.", "llc", "n.v.", "b.v.")
ORGANIZATION_ALIASES = {
    "Qualcomm": ("Qualcomm Incorporated", "Qualcomm Inc."),
    "Ericsson": ("Ericsson LM", "Telefonaktiebolaget LM Ericsson"),
    "Nokia": ("Nokia Bell Labs",),
    "Samsung": ("Samsung Electronics",),
    "ZTE": ("ZTE Corporation",),
    "vivo": ("Vivo Mobile Communications",),
}

# --- fixed values: limits and defaults ------------------------------------------------------
MIN_INGESTION_COVERAGE = 0.995
RRF_K = 60
TOPIC_MIN_CONFIDENCE = 0.65
EXCERPT_CHARS = 500

# --- fixed values: patterns -------------------------------------------------------------------
TOKEN_PATTERN = r"[a-z0-9]+(?:[._/-][a-z0-9]+)*"
NUMBER_PATTERN = r"\b\d+(?:\.\d+)*\b"
MEETING_ID_PATTERN = r"^[A-Z0-9]+-(\d+)(?:-(.+))?$"
PAGE_TITLE_PATTERN = r"(?i)^Page\s+(\d+)$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SUPPORTED_SUFFIXES = (".doc", ".docx", ".docm", ".pdf", ".pptx", ".txt", ".xlsx", ".zip")
