"""Fixed values of the matching rules.

Everything in this module is a plain constant: word lists, weights, thresholds,
patterns and message formats that decide the results. They are kept together so
that a reader can check the rule set without reading any expression code.
"""

# --- Fixed values: score weights (sum to 100) --------------------------------
WEIGHTS = {
    "role_family_score": 20,
    "capability_score": 20,
    "evidence_score": 15,
    "title_alignment_score": 10,
    "experience_fit_score": 10,
    "career_level_fit": 10,
    "location_fit": 8,
    "industry_fit": 4,
    "salary_fit": 3,
}
REQUIRED_EVIDENCE_WEIGHT = 12
NICE_EVIDENCE_WEIGHT = 3
WORK_MODE_WEIGHT = 4
LOCATION_WEIGHT = 4
INDUSTRY_WEIGHT = 3
COMPANY_SIZE_WEIGHT = 1
STRENGTH_SCORE = {"professional": 1.0, "practical": 0.65, "none": 0.0}
MISMATCH_DAMPENING = 0.2
UNKNOWN_DAMPENING = 0.6
AUTO_APPLY_MIN_SCORE = 85
REVIEW_MIN_SCORE = 75
AUTO_APPLY_MAX_GAP = 0.0
REVIEW_MAX_GAP = 2.0
LEGITIMATE_MIN_DESCRIPTION = 50

# --- Fixed values: role families ----------------------------------------------
# First class whose phrase occurs wins; the order is part of the rule.
FAMILY_PHRASES = [
    ("LEGAL", ["counsel", "attorney", "paralegal"]),
    ("HR", ["recruiter", "recruitment", "hr business partner", "human resources", "talent acquisition"]),
    ("MARKETING", ["marketing"]),
    ("SALES", ["sales", "account executive", "business development"]),
    ("OTHER_TECH", [
        "software engineer", "data scientist", "devops", "qa engineer", "quality assurance",
        "site reliability", "sre", "backend engineer", "frontend engineer", "full stack",
        "machine learning engineer",
    ]),
]
# (primary, secondary) capabilities per family.
FAMILY_NEEDS = {
    "PRODUCT": (["product_management", "analytics"],
                ["stakeholder_communication", "requirements_gathering", "documentation"]),
    "BUSINESS_ANALYSIS": (["business_analysis", "requirements_gathering", "documentation"],
                          ["stakeholder_communication", "analytics"]),
    "PROJECT_PROGRAM": (["project_management", "stakeholder_communication"],
                        ["agile_scrum", "documentation"]),
    "OTHER_TECH": (["software_development"], ["ai_tools"]),
    "SALES": ([], ["stakeholder_communication"]),
    "LEGAL": ([], []),
    "MARKETING": ([], ["stakeholder_communication"]),
    "HR": ([], []),
    "UNKNOWN": (["business_analysis", "project_management"],
                ["stakeholder_communication", "documentation"]),
}
TRANSFERABLE_CAPABILITIES = [
    "stakeholder_communication", "documentation", "requirements_gathering", "client_facing",
]

# --- Fixed values: career levels ----------------------------------------------
SENIOR_LEVELS = ["SENIOR", "LEAD", "MANAGER", "DIRECTOR", "EXECUTIVE"]
ENTRY_LEVELS = ["ENTRY_LEVEL", "JUNIOR"]
LEVEL_MARKERS = [
    ("EXECUTIVE", ["chief", "ceo", "cto", "coo", "vice president", "vp"]),
    ("DIRECTOR", ["associate director", "director", "head of"]),
    ("SENIOR", ["senior", "sr", "principal", "staff"]),
    ("LEAD", ["lead", "group product", "group manager"]),
    ("INTERN", ["intern", "internship"]),
    ("ENTRY_LEVEL", ["entry level", "entry-level", "fresher", "graduate trainee", "trainee"]),
    ("JUNIOR", ["associate", "junior", "jr"]),
]
# Titles in which "manager" names the function, not a people-management level.
FUNCTION_TITLE_PHRASES = [
    "product manager", "project manager", "program manager", "product owner", "product analyst",
    "product management", "program management", "project management", "business analyst",
    "project coordinator", "program coordinator",
]

# --- Fixed values: words ------------------------------------------------------
# canonical form -> word forms. Scoring knows one group more than collection.
COLLECT_WORD_FORMS = {
    "manage": ["manager", "managers", "management", "managing"],
    "analy": ["analyst", "analysts", "analysis", "analytics"],
    "coordinat": ["coordinator", "coordinators", "coordination", "coordinating"],
    "associat": ["associate", "associates", "association"],
}
SCORE_WORD_FORMS = {**COLLECT_WORD_FORMS, "own": ["owner", "owners", "ownership"]}
STOPWORDS = [
    "the", "and", "of", "with", "for", "in", "to", "is", "are", "on", "as", "an", "or",
    "at", "by", "be", "this", "that", "will", "into", "from", "using", "your", "you",
    "our", "other", "such", "than", "then", "have", "has", "not", "but", "all", "can",
]

# --- Fixed values: search expansion -------------------------------------------
TITLE_VARIANTS = [
    (["product"], [
        "Product Manager", "Associate Product Manager", "APM", "Product Analyst",
        "Product Management Analyst", "Product Specialist", "Product Operations",
        "Product Operations Analyst",
    ]),
    (["business", "analyst", "analysis"], [
        "Business Analyst", "Business Analysis", "Business Systems Analyst",
        "Functional Analyst", "Business Operations Analyst",
    ]),
    (["project", "program", "coordinator"], [
        "Project Manager", "Project Coordinator", "Project Analyst", "PMO Analyst",
        "Project Management Analyst", "Program Coordinator", "Program Analyst",
        "Program Manager", "Technical Program Manager",
    ]),
]
REMOTE_PSEUDO_LOCATIONS = ["Remote", "Remote India", "Work From Home India", "Hybrid India"]
REMOTE_LOCATION_WORDS = ["remote", "work from home", "wfh"]

# --- Fixed values: connectors and pages -----------------------------------------
CONNECTOR_ORDER = ["lever", "greenhouse", "ashby", "smartrecruiters", "workday"]
PAGE_SIZE = {"smartrecruiters": 100, "workday": 20}
BOARD_CONNECTORS = ["greenhouse", "lever", "ashby"]

# --- Fixed values: extraction patterns ----------------------------------------
EXPERIENCE_RANGE = r"(?iU)(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*years?"
EXPERIENCE_PLUS = r"(?iU)(\d+(?:\.\d+)?)\s*\+\s*years?"
EXPERIENCE_MINIMUM = r"(?iU)minimum\s*(\d+(?:\.\d+)?)\s*years?"
SALARY_RANGE = r"(?U)\$\s*([\d,.]+)\s*([kKmM]?)\s*[-–]\s*\$?\s*([\d,.]+)\s*([kKmM]?)"
SALARY_CURRENCY = "USD"
LEVER_SKILL_LABELS = ["skill"]
LEVER_REQUIREMENT_LABELS = ["experience", "what you will need", "requirement", "qualification"]
WORKDAY_REQUIRED_LABEL = "Must have skills"
WORKDAY_PREFERRED_LABEL = "Good to have skills"

# --- Fixed values: generated-text checks --------------------------------------
YEARS_CLAIM = r"(?iU)(\d+(?:\.\d+)?)\+?\s*years?\s+(?:of\s+)?(?:professional\s+|full-?time\s+)?experience"
YEARS_TOLERANCE = 0.5
EMPLOYER_MENTION = r"(?U)\b(?:at|for)\s+([A-Z][a-zA-Z&]+(?:\s+[A-Z][a-zA-Z&]+){0,3})\b"
NUMERIC_CLAIM = r"(?U)\b(\d+(?:\.\d+)?%|\d{2,}\+?)\b"
GENERIC_CAPITALIZED_TERMS = [
    "business analyst", "project manager", "product manager", "project coordinator",
    "associate product manager", "agile", "scrum", "sql", "excel", "tableau",
    "microsoft word", "google", "linkedin learning", "iiba",
]
GAP_PATTERNS = [
    r"\bbelow the\b",
    r"\bfewer years\b",
    r"\bunder-?qualified\b",
    r"\bstretch (?:role|application|fit)\b",
    r"\bdoes(?:n't| not) meet\b",
    r"\bfalls? short\b",
    r"\bshort of the\b",
    r"\bexperience gap\b",
    r"\bgap in (?:my |the )?experience\b",
    r"\bnot eligible\b",
    r"\bI only have\b",
    r"\bI want to be transparent\b",
    r"\byears? short\b",
    r"\bdo(?:n't| not) (?:currently )?meet the (?:required|stated|minimum)\b",
    r"\black(?:ing)? (?:the )?(?:required|stated|necessary) (?:experience|years|qualifications?)\b",
]
URL_OR_EMAIL = r"(?U)(https?://\S+|www\.\S+|\b[\w.+-]+@[\w-]+\.[\w.-]+\b)"
REPEATED_WHITESPACE = r"[ \t]{2,}|\n{3,}"
MISSING_SPACE_PUNCTUATION = r"[A-Za-z][,:;!?][A-Za-z]"
FUSED_WORD = r"(?U)\b[a-z]{22,}\b"
ABBREVIATIONS = [
    "e.g", "i.e", "etc", "vs", "mr", "mrs", "ms", "dr", "inc", "ltd", "llp", "llc", "corp",
    "st", "jr", "sr",
]
SNIPPET_CHARS = 15

# --- Fixed values: generated artifacts ----------------------------------------
ANALYSIS_FIELDS = [
    "target_role", "company", "core_mission", "must_have_requirements", "nice_to_have_requirements",
    "core_responsibilities", "technical_skills", "product_skills", "business_skills", "project_skills",
    "communication_skills", "domain_requirements", "seniority_signals", "success_signals",
    "candidate_matches", "candidate_gaps", "evidence_to_highlight", "unsupported_claims_to_avoid",
    "resume_keywords", "cover_letter_angles", "application_strategy", "confidence",
]
RESUME_FIELDS = [
    "summary", "highlighted_experience", "highlighted_projects", "skills_to_feature", "keywords_used",
]
COVER_LETTER_FIELDS = ["cover_letter_needed", "reason", "body"]
VERSIONS = {
    "analysis": "fit-analysis/1",
    "resume": "resume/1",
    "cover_letter": "cover-letter/1",
    "answer": "answer/1",
}
CONFIDENCE_LEVELS = ["HIGH", "MEDIUM", "LOW", "NEEDS_USER_INPUT"]
STANDARD_QUESTIONS = [
    "Why do you want this role?",
    "Why this company?",
    "Tell us about yourself.",
    "Describe a relevant project.",
    "Describe a challenge you solved.",
    "Why should we hire you?",
    "What are your salary expectations?",
    "What is your current notice period?",
    "Are you willing to relocate?",
    "Are you authorized to work in this location?",
]
YEARS_QUESTION = r"(?iU)(?:do you have|have you|at least)\D{0,15}(\d+(?:\.\d+)?)\+?\s*years?"
ACTIONABLE_DECISIONS = ["AUTO_APPLY", "REVIEW"]
GAP_MENTIONS_ALLOWED = {"resume": 0, "cover_letter": 1}

# --- Fixed values: reviews ----------------------------------------------------
REVIEW_STATUSES = ["PENDING", "APPROVED", "NEEDS_CHANGES", "REJECTED"]
REVIEW_ACTIONS = {"approve": "APPROVED", "needs_changes": "NEEDS_CHANGES", "reject": "REJECTED"}
QUALITY_FIELDS = [
    "analysis_quality", "resume_quality", "cover_letter_quality", "answers_quality",
    "truthfulness", "overall_quality",
]

# --- Fixed values: characters a Python-style strip removes ---------------------
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
