"""Word lists, patterns and lookup tables.

Everything here is data. Each function that needs a lexicon takes it as a
parameter and falls back to the value below, so a caller can extend one
without touching the code that applies it.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Fixed values. Results depend on the content and, for the classifier tables,
# on the order of the labels (the first label with a hit wins).
# --------------------------------------------------------------------------

SKILLS = {
    "aws": ["aws"],
    "azure": ["azure"],
    "beautifulsoup": ["beautifulsoup", "beautiful soup"],
    "celery": ["celery"],
    "css": ["css"],
    "data engineering": ["data engineering"],
    "django": ["django"],
    "docker": ["docker"],
    "fastapi": ["fastapi"],
    "flask": ["flask"],
    "gcp": ["gcp", "google cloud"],
    "git": ["git"],
    "go": ["go", "golang"],
    "graphql": ["graphql"],
    "html": ["html"],
    "httpx": ["httpx"],
    "java": ["java"],
    "javascript": ["javascript"],
    "kubernetes": ["kubernetes"],
    "linux": ["linux"],
    "machine learning": ["machine learning"],
    "mysql": ["mysql"],
    "node": ["node", "node.js", "nodejs"],
    "pandas": ["pandas"],
    "postgresql": ["postgresql"],
    "python": ["python"],
    "pytest": ["pytest"],
    "react": ["react"],
    "redis": ["redis"],
    "rest": ["rest", "restful"],
    "ruby": ["ruby"],
    "rust": ["rust"],
    "scala": ["scala"],
    "sql": ["sql"],
    "sqlite": ["sqlite"],
    "terraform": ["terraform"],
    "typescript": ["typescript"],
    "vue": ["vue", "vue.js"],
}

SKILL_ALIASES = {
    "bs4": "beautifulsoup",
    "k8s": "kubernetes",
    "node.js": "node",
    "nodejs": "node",
    "postgres": "postgresql",
    "py": "python",
    "ts": "typescript",
}

IGNORED_TAGS = [
    "anywhere", "contract", "full-time", "full time", "hybrid", "internship", "on-site", "onsite",
    "part-time", "part time", "remote", "temporary", "worldwide",
]

# Classifier entries are whole-word phrases; [-\s]? marks an optional joiner.
REMOTE_TYPES = {
    "hybrid": ["hybrid", r"remote[-\s]?first"],
    "onsite": ["onsite", r"on[-\s]?site", r"in[-\s]?office"],
    "remote": ["remote", "work from home", "worldwide", "anywhere", "distributed"],
}

EMPLOYMENT_TYPES = {
    "full_time": [r"full[\s_-]?time", "permanent"],
    "part_time": [r"part[\s_-]?time"],
    "contract": ["contract", "freelance", "consultant"],
    "internship": ["intern", "internship", "apprentice", "apprenticeship"],
    "temporary": ["temporary", "temp", r"fixed[-\s]?term"],
}

SENIORITY_LEVELS = {
    "executive": ["chief", "executive", "cxo"],
    "director": ["director", "vp", "vice president"],
    "manager": ["manager", "head of"],
    "lead": ["lead", "principal", "staff"],
    "senior": ["senior", "sr"],
    "mid": [r"mid[-\s]?level", "intermediate", "mid"],
    "junior": ["junior", "jr", r"entry[-\s]?level"],
    "intern": ["intern", "internship"],
}

# A bracketed group holding one of these is dropped from a title.
TITLE_BRACKET_WORDS = [
    "remote", "hybrid", r"on[-\s]?site", "onsite", "worldwide", "anywhere", r"full[\s-]?time",
    r"part[\s-]?time", "contract", "freelance", "internship", "intern", "temporary", "temp",
]

# These are dropped from a title wherever they stand as whole words.
TITLE_NOISE_WORDS = [
    "remote", "hybrid", "onsite", r"on[-\s]?site", "worldwide", "anywhere", r"full[\s-]?time",
    r"part[\s-]?time", "contract", "freelance", "temporary", "temp", "senior", r"sr\.?", "junior",
    r"jr\.?", "lead", "principal", "staff", r"mid[-\s]?level", "mid", "internship", "intern",
]

TITLE_ACRONYMS = {
    "ai": "AI", "api": "API", "aws": "AWS", "css": "CSS", "gcp": "GCP", "html": "HTML", "ios": "iOS",
    "ml": "ML", "qa": "QA", "sql": "SQL", "sre": "SRE", "ui": "UI", "ux": "UX",
}

TITLE_SMALL_WORDS = ["and", "for", "in", "of", "on", "to", "with"]

TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"

PLACELESS_WORDS = ["remote", "worldwide", "anywhere"]

TURKEY_MARKERS = [
    "turkey", "turkiye", "türkiye", "istanbul", "i̇stanbul", "ankara", "izmir", "i̇zmir", " tr ",
]

# Source precedence: (name, url, payload type), earlier wins.
SOURCES = [
    ("arbeitnow", "https://www.arbeitnow.com/api/job-board-api", "json"),
    ("remotive", "https://remotive.com/api/remote-jobs", "json"),
    ("themuse", "https://www.themuse.com/api/public/jobs?page=1", "json"),
    ("kariyer", "https://www.kariyer.net/is-ilanlari/yazilim", "html"),
]

DEFAULT_SOURCE = "public-source"
MISSING_SOURCE_ID = "missing-source-id"
UNKNOWN_COMPANY = "unknown-company"
UNKNOWN_TITLE = "unknown-title"
SNIPPET_LENGTH = 280
MAX_URL_LENGTH = 2083
PAGE_SIZE_DEFAULT = 10
PAGE_SIZE_MAX = 50
INSIGHT_LIMIT_DEFAULT = 10
MATCH_POOL = 100
MATCH_POOL_MAX = 10_000
MATCH_RESULTS = 5

# CSS selectors of the two HTML layouts, tried left to right.
GENERIC_HTML = {
    "nodes": ["tr.job", "article.job", "div.job", "section.job"],
    "link": ["a[itemprop='url']", "a.preventLink", "a[href]"],
    "title": ["h2[itemprop='title']", "h2", "[data-position]", ".position h2"],
    "company": ["h3[itemprop='name']", "h3", "[data-company]", ".company h3"],
    "location_raw": [".location", "[data-location]", ".company_and_position .location", ".company .location"],
    "salary_text": [".salary", "[data-salary]"],
    "description_text": [".description", ".description p", ".description-text", "[data-description]"],
    "employment_type_raw": [".employment", "[data-employment]"],
    "remote_type_raw": [".remote", "[data-remote]"],
    "tags": [".tags h3", ".tags .tag", ".tag", ".skill", "[data-tag]"],
    "id_attributes": ["data-id", "data-job-id", "id"],
}

CARD_HTML = {
    "nodes": [
        "div[data-testid='job-item']", "div[class*='job-card']", "div[class*='list-item']",
        "article[class*='job']", "li[class*='job']",
    ],
    "link": ["a[data-testid='job-title']", "a[class*='job-title']", "h3 a", "h2 a", "a[href]"],
    "title": ["[data-testid='job-title']", "h3", "h2", "[class*='job-title']", "[class*='title']"],
    "company": ["[data-testid='company-name']", "[class*='company-name']", "[class*='company']"],
    "location_raw": ["[data-testid='job-location']", "[class*='location']", "[class*='city']"],
    "id_attributes": ["data-id", "id"],
}

UNUSABLE_HREFS = ["#", "javascript:", "mailto:", "tel:"]
