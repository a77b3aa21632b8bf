"""The patterns of redaction, verdicts and entities."""

REDACTION = [
    ("private-key-block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("api-key", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{5,}\b"),
    ("bearer-token", r"\bBearer\s+[A-Za-z0-9._~+/-]{16,}=*"),
    (
        "env-assignment",
        r"(?m)^([ \t]*(?:export[ \t]+)?[A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|API_?KEY|ACCESS_KEY|PRIVATE_KEY)[A-Z0-9_]*[ \t]*=)[^\r\n]+$",
    ),
]

#: What build logs and test runs keep, and their verdict vocabularies.
BUILD_LOG = {
    "relevant": "error|failed",
    "pass": [r"build: Done", r"\bDone in ", r"\bbuild (?:succeeded|completed)\b"],
    "fail": [r"\berror TS\d+", r"\bbuild failed\b", r"ELIFECYCLE", r"^.+\(\d+,\d+\): error "],
    "fail2": [r"\berror\b", r"\b\w+Error\b", r"\bBUILD FAILED\b", r"npm ERR!"],
}
TEST_OUTPUT = {
    "relevant": "FAIL|failed|AssertionError|expected|Expected|Received|→|×",
    "summary": r"Test Files|Tests +\d|Duration",
    "pass": [r"Tests {2,}\d+ passed \(\d+\)$", r"^\w[\w -]* verified\r?$"],
    "fail": [r"\b\d+ failed\b", r"^FAIL\b"],
    "fail2": ["FAIL ", "AssertionError", r"^FAIL\b"],
}

#: Code entities, pattern and the group that names the entity.
CODE_ENTITIES = [
    (r"[A-Za-z0-9_@./\\-]+\.[a-z]{1,6}(?::\d+)?", 0),
    (r"\bv?\d+\.\d+\.\d+[-.\w]*\b", 0),
    (r"\b(?:TS|E|ERR_)[A-Z0-9_]*\d[A-Z0-9_]*\b", 0),
    (r"[\"'`]([A-Za-z_$][A-Za-z0-9_$]*)[\"'`]", 1),
    (r"\b\d+(?:\.\d+)?\b", 0),
]

#: Entities of prose, pattern and the group that names the entity.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
PROSE_ENTITIES = [
    (r"\b\d{4}-\d{2}-\d{2}\b", 0),
    (rf"\b(?:{_MONTHS})\s+\d{{1,2}},\s+\d{{4}}\b", 0),
    (rf"\b\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}\b", 0),
    (r"[\"“]([A-Z][A-Za-z][^\"“”\n]{0,38})[\"”]", 1),
    (r"\b(?:[A-Z][A-Za-z&.-]*\s+)+(?:Ltd|Limited|LLC|LLP|Inc|Incorporated|Corp|Corporation|GmbH|Company|Partners)\b", 0),
    (r"(?i)\b(?:Section|Clause|Article|Schedule|Exhibit|Appendix|Paragraph)\s+\d+(?:\.\d+)*\b", 0),
    (r"§\s?\d+(?:\.\d+)*", 0),
    (r"\b(?:USD|EUR|GBP|INR|CHF|JPY|AUD|CAD)\s?\d[\d,]*(?:\.\d+)?\b", 0),
    (r"[$€£₹]\s?\d[\d,]*(?:\.\d+)?", 0),
    (r"\b\d+(?:\.\d+)?\s?%", 0),
    (r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b", 0),
]
#: Fixed value: words of a hard prompt.
HARD_PROMPT = r"(?i)\b(refactor|architect|design|migrate|debug|rewrite|overhaul|end.to.end|across the (?:repo|codebase))\b"

#: Headings of plain text.
NUMBERED = r"^(\d+(?:\.\d+)*)[.)]\s+(\S.*)$"
NAMED = r"(?i)^(Example|Claim|Part|Section|Chapter|Appendix|Figure|Table|Exhibit|Case|Note)\s+([0-9]+|[IVXLCDM]+|One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve)(?:\s*[:.\-—]\s*(.+))?$"
LETTERED = r"^\(?([A-Z])[.)]\s+(\S.*)$"
ALL_CAPS = r"^[A-Z][A-Z0-9 ,&'()/-]{2,89}$"
TITLE_CASE = r"^[A-Z][a-z0-9-]+(?:\s+(?:[A-Z][a-z0-9-]+|of|the|and|for|to|in|a|an|on|at|by|with|from|or|as|but|vs)){1,7}$"

#: Fixed value: a line of these signs alone is no running header.
HEADER_NOISE = r"^[\s\d.,;:|/\\-]*$"

#: Words that are no keywords, words of no weight in a heading, and section references.
STOPWORDS = (
    "this", "that", "with", "from", "into", "what", "where", "when", "how", "does", "the", "and", "for", "are", "has", "have",
    "your", "their", "over", "each", "must", "its", "was", "were",
)
#: Fixed values of the code search: its stop words and the verbs that open a request for a change; how a query names a page.
GOAL_STOPWORDS = (
    "this", "that", "with", "from", "into", "what", "where", "when", "how", "does", "the", "and", "for", "are", "has", "have",
    "your", "their", "over", "each", "exactly", "produces", "returns", "instead",
)
MUTATION_OPENER = r"(?i)^\s*(fix|implement|add|write|create|delete|remove|refactor|edit|change|update|rename)\b"
PAGE_QUERY = r"(?i)^(?:p|page)\.?\s*(\d+)$"
HEADING_STOPWORDS = ("of", "the", "and", "for", "to", "in", "a", "an", "on", "at", "by", "with", "from", "or", "as", "but", "vs")
SECTION_MARK = r"§\s*([A-Za-z0-9][\w.-]*)"
ID_HALVES = r"^(?:([a-z]+)-)?(\d+(?:\.\d+)*|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)(?:-\d+)?$"
SECTION_REF = r"(?i)\b(example|claim|part|section|sec|chapter|appendix|figure|table|exhibit|case|note)\s+(\d+(?:\.\d+)*|[ivxlcdm]+\b|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b"

#: Which commands are wrapped. Rules in order, tested case-blind; any deny rule wins.
REWRITE_ALLOW = [
    ("typecheck", r"\btsc\b"),
    ("build", r"\bbuild\b"),
    ("test", r"\b(?:vitest|jest|pytest|mocha|ava|(?:pnpm|npm|yarn|bun)(?: run)? test)\b"),
    ("lint", r"\b(?:eslint|tslint|(?:pnpm|npm|yarn|bun)(?: run)? lint)\b"),
    ("node-script", r"\bnode\s+(?:[\w.\\/-]+[\\/])?(?:verify|test|check)[\w.-]*\.[cm]?js\b"),
]
REWRITE_DENY = [
    ("shell-composition", r"[><;|]|&&|\|\||\$\(|`"),
    ("mutation", r"\b(?:rm|rmdir|mv|cp|del|erase|install|publish|push|commit|reset|clean|checkout|mkdir)\b"),
]
CD_PREFIX = r"""^\s*cd\s+(?:"[^"]*"|'[^']*'|[^\s&|;<>"']+)\s*&&\s*"""
MERGED_OUTPUT = r"\d*>&\d+"

#: Exported declarations, relative imports, and the roles of folders by name, in order.
DECLARATION = r"^\s*(export (?:async )?(?:function|class|interface|type|const|enum|abstract class) ([A-Za-z0-9_$]+).*)$"
PLAIN_DECLARATION = r"^((?:class|def) ([A-Za-z0-9_$]+).*)$"
RELATIVE_IMPORT = r"""^\s*import .*?from\s+['"](\.[^'"]+)['"]"""
RELATIVE_FROM = r"^\s*from\s+(\.[^\s]+)\s+import"
FOLDER_ROLES = [
    ("test", "tests"), ("^(?:src|lib)$", "implementation"), ("script", "maintenance scripts"), ("fixture", "test fixtures"), ("doc", "documentation"),
]
SECTION_ANCHOR = r"§([\w./:-]+)"
