"""Word lists and patterns that results depend on."""

# Content-free words of questions and passages.
STOPWORDS = (
    "a an the this that these those there here is are was were be been being am do does did doing done "
    "of in on at to for from by with within into onto about as and or but if then than so such "
    "i me my we our you your it its what which who whom whose when where why how "
    "can could would should will please tell show give find explain summarise summarize"
).split()

# Word families, canonical form first.
FAMILIES = [
    line.split()
    for line in """
    terminate terminates terminated terminating termination terminations
    indemnify indemnifies indemnified indemnifying indemnification indemnity indemnities
    confidential confidentiality confidentially
    disclose discloses disclosed disclosing disclosure disclosures nondisclosure non-disclosure
    liable liability liabilities
    notice notices notification notifications notify notified notifying
    pay pays paid paying payment payments payable
    oblige obligation obligations obligated obliged
    warrant warrants warranted warranty warranties
    assign assigns assigned assignment assignments
    govern governs governed governing governance
    arbitrate arbitrates arbitrated arbitration arbitrations arbitrator arbitrators
    breach breaches breached breaching
    renew renews renewed renewing renewal renewals
    expire expires expired expiring expiration expiry
    amend amends amended amending amendment amendments
    limit limits limited limiting limitation limitations
    damage damages
    fee fees
    invoice invoices invoiced invoicing
    party parties
    agree agrees agreed agreement agreements
    dispute disputes disputed
    jurisdiction jurisdictions
    force-majeure majeure
    """.strip().splitlines()
]

# Leading wrappers of a question, tried in this order.
FILLERS = [
    r"^\s*(?:hi|hey|hello)[,!.\s]+",
    r"^\s*(?:can|could|would)\s+you\s+(?:please\s+)?(?:tell\s+me|show\s+me|explain|find|check|confirm)\s*",
    r"^\s*(?:please|kindly)\s+",
    r"^\s*i\s+(?:would\s+like|want|need)\s+to\s+know\s+",
    r"^\s*(?:what|which)\s+does\s+(?:the|this|my)\s+(?:contract|agreement|document|nda|policy)\s+say\s+about\s+",
    r"^\s*according\s+to\s+(?:the|this|my)\s+(?:contract|agreement|document)[,\s]+",
    r"^\s*(?:tell|explain)\s+me\s+(?:about\s+)?",
    r"^\s*(?:what|who|when|where|how|why)\s+(?:is|are|was|were)\s+(?:the\s+)?",
    r"^\s*in\s+(?:the|this)\s+(?:contract|agreement|document)[,\s]+",
]

# Kinds of clause references, and the long form of the short ones.
REFERENCE = (
    r"\b(clause|section|sec|article|art|schedule|sched|exhibit|annex|appendix|paragraph|para|item)\.?\s*"
    r"([0-9]+(?:\.[0-9]+)*(?:\s*\([a-z0-9]{1,4}\))?|[ivxlcdm]{1,7}\b|[a-z]\b)"
)
BARE_REFERENCE = r"(?<![\w.])(\d{1,2}(?:\.\d{1,3}){1,3})(?![\w.])"
REFERENCE_KINDS = {"sec": "section", "art": "article", "sched": "schedule", "para": "paragraph"}
QUOTED = "[\"“‘']([^\"”’']{3,120})[\"”’']"
TOKEN = r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*"
PIECE = r"[A-Za-z]+|\d[\d.,]*|[^\sA-Za-z\d]"

# Glyphs and their plain forms.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
PUNCTUATION = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "′": "'", "″": '"',
    " ": " ", " ": " ", " ": " ", " ": " ", "​": "", "‌": "", "‍": "", "﻿": "", " ": "\n", " ": "\n", "­": "",
}

# Lines that are page numbers.
PAGE_NUMBERS = [
    r"^\s*[-–—(\[]*\s*\d{1,4}\s*[-–—)\]]*\s*$",
    r"(?i)^\s*page\s+\d{1,4}(\s+of\s+\d{1,4})?\s*$",
    r"^\s*\d{1,4}\s*(?:/|\|)\s*\d{1,4}\s*$",
    r"(?i)^\s*[ivxlcdm]{1,7}\s*$",
]

# Heading patterns and names.
NUMBERED_HEADING = r"^\s*(\d{1,2}(?:\.\d{1,3}){0,3})[.)]?\s+([A-Z][^\n]{2,80})$"
LABELLED_HEADING = (
    r"(?i)^\s*(ARTICLE|SECTION|CLAUSE|SCHEDULE|EXHIBIT|ANNEX(?:URE)?|APPENDIX|PART|RECITAL|PREAMBLE)"
    r"\s+([IVXLCDM]+|\d{1,3}|[A-Z])\b[\s:.–-]*(.{0,80})$"
)
CAPITAL_HEADING = r"^\s*([A-Z][A-Z0-9 ,.'&()/–-]{3,80})\s*$"
BARE_HEADING = r"^\s*(\d{1,2}(?:\.\d{1,3}){1,3})\s*$"
SECTION_NAMES = [
    "definitions", "interpretation", "term", "renewal", "termination", "liability", "limitation of liability", "indemnity",
    "indemnification", "confidentiality", "governing law", "jurisdiction", "payment", "fees", "fees and payment", "warranty",
    "warranties", "force majeure", "assignment", "dispute resolution", "arbitration", "notices", "severability",
    "entire agreement", "scope of work", "deliverables", "intellectual property", "data protection", "privacy", "insurance",
    "compliance", "audit", "subcontracting", "amendment", "waiver", "counterparts", "survival", "representations", "covenants",
]
FURNITURE_WORDS = ["page", "continued", "confidential", "draft", "exhibit page"]

# Document kinds in order of precedence, with the strings that hint at them.
TYPE_HINTS = [
    ("nda", ["non-disclosure", "nondisclosure", "_nda", "nda_", " nda"]),
    ("contract", ["agreement", "contract", "msa", "sow", "addendum"]),
    ("judgment", ["judgment", "judgement", " v. ", " vs ", "tribunal"]),
    ("policy", ["policy", "policies", "guideline"]),
    ("invoice", ["invoice", "bill of "]),
    ("letter", ["letter", "notice of"]),
]


def word_union(*lists: list[str]) -> list[str]:
    """The distinct words of several lists, sorted."""
    return sorted(set().union(*lists))
