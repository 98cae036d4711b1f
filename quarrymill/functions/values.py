"""Lists and patterns that results depend on, as text, in natural order."""

#: Function words that keyword search leaves out, English then Italian.
STOP_WORDS = (
    "a an and are as at be but by for from has have if in into is it its of on or that the their then there these they this to was were will with "
    "il lo la i gli le un uno una di del della dei delle dello da dal dalla dai dalle in nel nella nei nelle su sul sulla sui sulle per con e ed o od ma che chi cui non si è al alla ai alle allo come anche più questo questa questi queste quello quella sono essere"
).split()

#: Function words by which a text shows its language.
ITALIAN_WORDS = "il la di che e per non una un del della con sono è gli le nel nella dei delle anche come questo viene essere".split()
ENGLISH_WORDS = "the and of to is in for with that are this on be as by from it an or can will which not has".split()

#: Okapi BM25.
BM25_K1, BM25_B = 1.2, 0.75

#: Characters of text for one token, prose and source code.
CHARS_PER_TOKEN, CODE_CHARS_PER_TOKEN = 3.5, 3.2

#: Rank fusion: constant, weights, candidates, results, passages a document.
RRF_K, RRF_WEIGHT_VECTOR, RRF_WEIGHT_KEYWORD, CANDIDATES, TOP_K, MAX_PER_DOCUMENT = 5, 1.0, 1.0, 24, 6, 3
AUTHORITY_BOOST = {"binding": 1.15, "normative": 1.12}
#: Near-duplicate passages: words a shingle, least shingles, containment.
SHINGLE_WORDS, LEAST_SHINGLES, CONTAINMENT = 5, 20, 0.8

#: Titles of pages that documentation tools generate.
GENERATED_TITLES = (
    r"(?i)^IO\.Swagger\.",
    r"(?i)^(?:[a-z_][\w]*\.){1,}[a-z_]\w*\s+(?:module|package|class|function)$",
    r"^(?:[A-Z][\w]*\.){2,}[A-Z]\w*$",
    r"(?i)^(?:Model|Api|Class|Interface|Enum|Package|Namespace):\s",
    r"(?i)^(?:Index of|Package Index|Module Index|Class Hierarchy)",
)
#: Marks in the bodies of generated pages.
GENERATED_BODIES = (
    r"(?i)\[\[Back to (?:Model list|API list|README)\]\]",
    r"(?i)\bThis file was (?:auto-?)?generated\b",
    r"(?m)^Bases:\s+`",
    r"(?i)<!--\s*(?:auto-?generated|generated by)",
    r"(?i)Generated by (?:Swagger Codegen|OpenAPI Generator|Sphinx|JavaDoc|TypeDoc|Doxygen)",
)
#: Readme files that project generators leave.
BOILERPLATE_READMES = (
    r"(?i)This project was bootstrapped with \[Create React App\]",
    r"(?m)^#\s*React \+ TypeScript \+ Vite\b",
    r"(?i)This template provides a minimal setup to get React working in Vite",
    r"(?i)This project was generated (?:with|using) \[Angular CLI\]",
    r"(?m)^#\s*Getting Started with Create React App",
    r"(?i)This is a \[Next\.js\]\(https://nextjs\.org\) project bootstrapped with",
    r"(?i)<p align=\"center\">\s*<a href=\"http://nestjs\.com/\"",
    r"(?i)## Description\s+\[Nest\]\(https://github\.com/nestjs/nest\) framework TypeScript starter repository",
    r"(?i)This project was generated using \[Nx\]",
    r"(?m)^#\s*Vue 3 \+ (?:TypeScript \+ )?Vite",
    r"(?i)To make it easy for you to get started with GitLab, here's a list of recommended next steps",
    r"(?im)^## Getting started\s+To make it easy for you to get started",
)

#: Secrets: rule name and pattern, our own.
SECRET_RULES = (
    ("analysis-token", r"\bsq[pua]_[0-9a-f]{40}\b"),
    ("package-token", r"\bnpm_[A-Za-z0-9]{36}\b"),
    ("forge-token", r"\bgl[a-z]{2,4}-[A-Za-z0-9_-]{20,}"),
    ("signed-token", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    ("signed-url", r"https://[^\s)\"']+[?&](?:sig|signature|token)=[A-Za-z0-9%_-]{16,}[^\s)\"']*"),
    ("client-secret", r"(?i)\bclient[_-]?secret[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9~._-]{16,}"),
)

#: Weights of relations when a document's neighbours are ranked; others weigh 0.7.
RELATION_WEIGHTS = {"links_to": 1.0, "child_of": 0.95, "documents": 0.95, "described_by": 0.9, "related_wiki": 0.8}
OTHER_RELATION_WEIGHT, INCOMING_PENALTY, MAX_HUB, RELATED_LIMIT = 0.7, 0.05, 60, 12
DOCUMENT_RELATIONS = ("links_to", "child_of", "described_by", "documents", "related_wiki")

#: Phrases by which an answer declines to answer, English then Italian.
ABSTENTION_SUBJECTS = (
    "(knowledge base|kb|provided (context|documents|documentation|sources)|available (context|documents|documentation|sources)|context|documentation|documents|sources)",
    "(knowledge base|kb|base di conoscenza|documentazione|contesto|documenti|fonti)( (fornit[ai]|fornit[ei]|disponibil[ei]|a disposizione))?",
)
ABSTENTIONS = (
    rf"\bthe {ABSTENTION_SUBJECTS[0]} (does not|doesn't|do not|don't|did not|didn't) (cover|contain|include|mention|address|provide|have|describe)",
    rf"\b(not|isn't|is not|aren't|are not) (covered|documented|available|found|mentioned|present|addressed|described) (in|by) the {ABSTENTION_SUBJECTS[0]}",
    r"\bthere is (no|not enough|insufficient) (information|documentation|detail)s? (in|about|on)\b",
    r"\b(no|not enough|insufficient) (information|details|documentation) (is |was |are |were )?(available|found|provided) (in|about|on)\b",
    r"could not find anything relevant",
    r"\b(cannot|can't|could not|couldn't|do not|don't|did not|didn't) find (any |no )?(information|mention|reference|evidence|anything|details)\b",
    r"\bthere is no (mention|reference|record|indication|information) (of|about|on)\b",
    rf"\b(cannot|can't|could not|couldn't|do not|don't|did not|didn't) find\b[^.]{{0,90}}\bin (the|any) {ABSTENTION_SUBJECTS[0]}",
    rf"\bno (mention|reference|indication) of\b.{{0,80}}\bin the {ABSTENTION_SUBJECTS[0]}",
    r"\bnon (trovo|risulta|risultano|compare|compaiono) (alcun|alcuna|nessun|nessuna|traccia|menzione)\b",
    r"\bnon (viene|vengono) (menzionat|citat|indicat|riportat)",
    r"\b(outside|beyond) the scope of the (knowledge base|documentation|context)",
    rf"\b(la|le|il|i|nella|nei)( (mia|mie|mio|miei|nostra|nostre|nostro|nostri))? {ABSTENTION_SUBJECTS[1]} non (copre|coprono|contiene|contengono|include|includono|menziona|menzionano|tratta|trattano|fornisce|forniscono|riporta|riportano|descrive|descrivono)",
    rf"\bnon (è|sono|viene|vengono) (coperto|coperta|coperti|coperte|trattato|trattata|trattati|trattate|documentato|documentata|documentati|documentate|presente|presenti|disponibile|disponibili|menzionato|menzionata) (nella|nel|nei|nelle|dalla|dal|dai|dalle) {ABSTENTION_SUBJECTS[1]}",
    r"\bnessuna informazione\b",
    r"\b(cannot|can't|could not|couldn't|am not able to) answer (this|that|your) question\b",
    r"\bnon (posso|riesco a|sono in grado di) rispondere\b",
    r"\bnon (ho|abbiamo) trovato\b",
    r"\bnon (sono|ci sono) (informazioni|dettagli|riferimenti) (su|riguardo|in merito|sul|sulla|sui)\b",
)

#: Language tags of source files by extension.
CODE_LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "scala": "scala", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "sql": "sql", "sh": "bash", "ps1": "powershell", "tf": "hcl",
    "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "xml": "xml", "html": "html", "css": "css", "scss": "scss", "vue": "vue", "proto": "protobuf", "graphql": "graphql", "gradle": "groovy",
}

#: How a decision record words its status, by status, the first that matches.
DECISION_STATUS = (
    ("template", r"^[\[{<]|proposed\s*[|/,]\s*accepted|accepted\s*[|/,]\s*(?:rejected|deprecated|superseded)|\bstatus here\b|such as|e\.g\.|ad esempio|what is the status|one of\b|^\.\.\.|^tbd$"),
    ("superseded", r"supersed|sostituit|replaced by|superat|rimpiazzat"),
    ("deprecated", r"deprecat|obsolet|outdated|no longer|non più|retired|withdrawn|ritirat|dismess|archiviat"),
    ("rejected", r"reject|rifiutat|respint|declined"),
    ("proposed", r"propos|draft|bozza|in review|under review|in revisione|in discussione|\brfc\b|\bwip\b|pending|in attesa"),
    ("accepted", r"accept|approv|accettat|adopt|adottat|in force|in vigore|\bactive\b|attiv|decided|decis|implemented|implementat|final"),
)

#: Lines that hold nothing but links, images or addresses.
LINK_ONLY = r"(?i)^\s*(?:[-*]\s*)?(?:\[[^\]]*\]\([^)]*\)\s*|\[image:[^\]]*\]\s*|<https?:[^>]+>\s*|https?://\S+\s*)+$"

#: How relations between documents read, outwards and inwards.
RELATION_LABELS = {
    "links_to": ("links to", "linked from"),
    "child_of": ("child of", "parent of"),
    "described_by": ("described by", "describes"),
    "documents": ("documents", "documented by"),
    "related_wiki": ("related wiki page", "related repository"),
}
