"""The rule catalogue, as data.

A rule belongs to a check, applies to files with certain suffixes, and finds
the lines that its pattern matches unless a guard holds.  ``needs`` are
substrings of the folded line of which every match has at least one; they let
most lines skip the pattern.  Where case is ignored they hold no i, as other
letters than I fold to it in a pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Suffixes and excluded directories of the scanners.
SUFFIXES = {
    "static": (".py", ".js", ".ts", ".jsx", ".tsx"),
    "security": (".py", ".js", ".ts", ".jsx", ".tsx", ".html", ".xml", ".yml", ".yaml"),
    "audit": (".py", ".js", ".ts", ".jsx", ".tsx", ".html", ".xml", ".yml", ".yaml", ".json", ".tf"),
    "arch": (".py",),
}
EXCLUDED = {
    "static": ("__pycache__", "node_modules", ".git", ".venv", "venv", ".tox", "egg-info", "dist", "build", ".mypy_cache"),
    "security": ("__pycache__", "node_modules", ".git", ".venv", "venv", ".tox", "egg-info", "dist", "build"),
    "audit": ("__pycache__", "node_modules", ".git", ".venv", "venv", ".tox", "egg-info", "dist", "build", ".mypy_cache"),
    "arch": ("__pycache__", "node_modules"),
}
WEB = (".js", ".ts", ".jsx", ".tsx", ".html")

#: Id, severity, suffixes, guard, whether case is ignored, needs, pattern.
PATTERNS = (
    ("SA-PY-1", "P1", "py", "", False, ("except",), r"except\s*:"),
    ("SA-PY-2", "P2", "py", "", False, ("print(",), r"print\("),
    ("SA-PY-3", "P2", "py", "hash", False, ("todo", "fixme", "hack"), r"TODO|FIXME|HACK"),
    ("SA-PY-4", "P2", "py", "", False, ("import",), r"import\s+\*"),
    ("SA-PY-5", "P2", "py", "", False, (".has_key(",), r"\.has_key\("),
    ("SA-PY-6", "P2", "py", "", False, ("true",), r"if\s+.*\s*==\s*True\b"),
    ("SA-PY-7", "P2", "py", "", False, ("none",), r"if\s+.*\s*==\s*None\b"),
    ("SA-JS-1", "P2", "js", "", False, ("console.log(",), r"console\.log\("),
    ("SA-JS-2", "P2", "js", "", False, ("var",), r"var\s+"),
    ("SA-JS-3", "P2", "js", "", False, ("==",), r"==(?!=)"),
    ("SEC-RX-1", "P0", "security", "comment", False, ("execute",), r"""execute\s*\(\s*['\"].*%\s*.*['\"]"""),
    ("SEC-RX-2", "P0", "security", "comment", False, (".execute",), r"""\.execute\s*\(\s*["']\s*SELECT.*\+"""),
    ("SEC-RX-3", "P0", "security", "comment", False, (".execute",), r"""\.execute\s*\(\s*f['\"]"""),
    ("SEC-RX-4", "P0", "security", "comment", True, ("key", "secret", "password", "token"), r"""(api_key|apikey|secret|password|token)\s*=\s*["'][^'"]{8,}["']"""),
    ("SEC-RX-5", "P0", "security", "comment", True, ("_key",), r"""(access_key|secret_key|private_key)\s*=\s*["'][^'"]+["']"""),
    ("SEC-RX-6", "P0", "security", "comment", False, ("innerhtml",), r"innerHTML\s*="),
    ("SEC-RX-7", "P1", "security", "comment", False, ("document.write(",), r"document\.write\("),
    ("SEC-RX-8", "P0", "security", "comment", False, ("os.system",), r"os\.system\s*\(\s*.*\+"),
    ("SEC-RX-9", "P0", "security", "comment", False, ("../",), r"(?:open|os\.path\.|Path|os\.chdir|os\.listdir|os\.remove|shutil)\s*\(.*\.\./"),
    ("SEC-RX-10", "P1", "security", "comment", True, ("password",), r"log.*password"),
    ("SEC-RX-11", "P2", "security", "comment", False, ("random.random",), r"random\.random\s*\("),
    ("AUD-INJ-1", "critical", "audit", "", True, ("execute",), r"""execute\s*\(\s*['\"].*%s"""),
    ("AUD-INJ-2", "critical", "audit", "", True, ("execute",), r"""execute\s*\(\s*f['\"]"""),
    ("AUD-INJ-3", "critical", "audit", "", True, ("execute",), r"""execute\s*\(\s*['\"].*\".*\+"""),
    ("AUD-INJ-4", "critical", "audit", "", True, ("rawquery",), r"rawQuery\s*\(\s*.*\+"),
    ("AUD-INJ-5", "critical", "audit", "", False, ("os.system",), r"os\.system\s*\(\s*.*\+"),
    ("AUD-INJ-6", "critical", "audit", "", False, ("subprocess.",), r"subprocess\.(call|Popen)\s*\(\s*.*\+"),
    ("AUD-INJ-7", "critical", "audit", "", False, ("eval",), r"eval\s*\(\s*.*\+"),
    ("AUD-SEN-1", "critical", "audit", "secret", True, ("password", "passwd", "secret"), r"""(password|passwd|secret)\s*=\s*["'][^"']{4,}["']"""),
    ("AUD-SEN-2", "critical", "audit", "secret", True, ("key",), r"""(api_key|apikey)\s*=\s*["'][^"']{8,}["']"""),
    ("AUD-SEN-3", "critical", "audit", "secret", True, ("token", "secret"), r"""(token|jwt_secret)\s*=\s*["'][^"']{8,}["']"""),
    ("AUD-SEN-4", "critical", "audit", "secret", True, ("aws_",), r"""aws_.*key\s*=\s*["'][^"']+["']"""),
    ("AUD-SEN-5", "high", "audit", "not-api", False, ("http://",), r"http://(?!localhost|127\.0\.0\.1)"),
    ("AUD-XSS-1", "critical", "web", "", False, ("innerhtml",), r"innerHTML\s*="),
    ("AUD-XSS-2", "high", "web", "", False, ("outerhtml",), r"outerHTML\s*="),
    ("AUD-XSS-3", "high", "web", "", False, ("document.write",), r"document\.write\s*\("),
    ("AUD-XSS-4", "critical", "web", "", False, ("eval",), r"eval\s*\(.*\+"),
    ("AUD-XSS-5", "high", "web", "", False, ("dangerouslysetinnerhtml",), r"dangerouslySetInnerHTML"),
    ("AUD-DES-1", "critical", "py", "raw", False, ("pickle.",), r"pickle\.loads?\("),
    ("AUD-DES-2", "critical", "py", "raw", False, ("cpickle.",), r"cPickle\.loads?\("),
    ("AUD-DES-3", "critical", "py", "raw", False, ("dill.",), r"dill\.loads?\("),
    ("AUD-DES-4", "critical", "py", "raw", False, ("yaml.load",), r"yaml\.load\s*\("),
    ("AUD-DES-5", "high", "py", "raw", False, ("marshal.",), r"marshal\.loads?\("),
    ("AUD-LOG-1", "medium", "audit", "", True, ("password",), r"log.*password"),
    ("AUD-LOG-2", "medium", "audit", "", True, ("token",), r"log.*token"),
    ("AUD-LOG-3", "medium", "audit", "", True, ("secret",), r"log.*secret"),
    ("AUD-LOG-4", "medium", "audit", "", True, ("cred",), r"log.*credit"),
    ("AUD-LOG-5", "medium", "audit", "", True, ("password",), r"print.*password"),
    ("AUD-PTH-1", "high", "audit", "", False, ("../",), r"\.\./"),
    ("AUD-PTH-2", "high", "audit", "", False, ("os.path.join",), r"os\.path\.join\s*\(.*request"),
    ("AUD-PTH-3", "high", "audit", "", False, ("open",), r"open\s*\(\s*.*\+.*request"),
    ("AUD-CRY-1", "medium", "audit", "", False, ("hashlib.md5",), r"hashlib\.md5\s*\("),
    ("AUD-CRY-2", "medium", "audit", "", False, ("hashlib.sha1",), r"hashlib\.sha1\s*\("),
    ("AUD-CRY-3", "medium", "audit", "", False, ("random.random",), r"random\.random\s*\("),
    ("AUD-CRY-4", "medium", "audit", "", False, ("random.randint",), r"random\.randint\s*\("),
)

#: OWASP categories.
INJECTION, XSS = "A03:2021 – Injection", "A03:2021 – Injection (XSS)"
IDENTIFICATION, INTEGRITY = "A07:2021 – 身份识别和身份验证失败", "A08:2021 – 软件和数据完整性故障"
LOGGING, CRYPTOGRAPHY = "A09:2021 – 安全日志记录和监控故障", "A02:2021 – 加密机制失效"
ACCESS, DESIGN = "A01:2021 – 访问控制失效", "A04:2021 – 不安全的设计"
#: OWASP category and CWE of rules or groups.
CLASSES = (
    (("SA-PY", "SA-JS"), "", ""),
    (("SEC-RX-1", "SEC-RX-2", "SEC-RX-3", "SEC-RX-8"), INJECTION, ""),
    (("SEC-RX-4",), IDENTIFICATION, ""),
    (("SEC-RX-5",), "A07:2021", ""),
    (("SEC-RX-6",), XSS, ""),
    (("SEC-RX-7",), "A03:2021", ""),
    (("SEC-RX-9",), "A01:2021", ""),
    (("SEC-RX-10",), LOGGING, ""),
    (("SEC-RX-11",), CRYPTOGRAPHY, ""),
    (("SEC-AST-1", "SEC-AST-3"), INJECTION, ""),
    (("SEC-AST-2",), INTEGRITY, ""),
    (("SEC-AST-4",), "A08:2021", ""),
    (("AUD-INJ-1", "AUD-INJ-2", "AUD-INJ-3", "AUD-INJ-4"), INJECTION, "CWE-89"),
    (("AUD-INJ-5", "AUD-INJ-6", "AUD-INJ-7"), INJECTION, "CWE-78"),
    (("AUD-ACC",), ACCESS, "CWE-862"),
    (("AUD-SEN-1", "AUD-SEN-2", "AUD-SEN-3", "AUD-SEN-4"), DESIGN, "CWE-798"),
    (("AUD-SEN-5",), CRYPTOGRAPHY, "CWE-319"),
    (("AUD-XSS",), XSS, "CWE-79"),
    (("AUD-DES",), INTEGRITY, "CWE-502"),
    (("AUD-LOG",), LOGGING, "CWE-532"),
    (("AUD-AST",), IDENTIFICATION, "CWE-798"),
    (("AUD-PTH",), ACCESS, "CWE-22"),
    (("AUD-CRY-1", "AUD-CRY-2"), CRYPTOGRAPHY, "CWE-328"),
    (("AUD-CRY-3", "AUD-CRY-4"), CRYPTOGRAPHY, "CWE-338"),
)

#: Call names of the syntax-tree rules, and their severities.
CALLS = {
    "SEC-AST-1": ("P0", ("eval", "exec")),
    "SEC-AST-2": ("P0", ("pickle.loads", "pickle.load", "cPickle.loads", "dill.loads")),
    "SEC-AST-3": ("P1", ("os.system", "os.popen", "subprocess.call", "subprocess.Popen")),
    "SEC-AST-4": ("P0", ("yaml.load",)),
}
#: Parts of names that hold secrets, and the least length of their values.
SECRET_NAMES = ("password", "passwd", "secret", "api_key", "apikey", "token", "private_key")
SECRET_LENGTH = 5
#: What marks a route and what marks its protection.
ROUTES = ("@app.route", "@router.")
PROTECTED = ("login_required", "@require_auth", "@permission")

#: Audit checks in the order in which they report.
AUDIT_ORDER = ("AUD-INJ", "AUD-ACC", "AUD-SEN", "AUD-XSS", "AUD-DES", "AUD-LOG", "AUD-AST", "AUD-PTH", "AUD-CRY")

#: Our own words: what each rule finds, and what to do.  %s stands for the name that was found.
ADVICE = {
    "SA-PY-1": ("except clause that names no exception", "name the exceptions that are expected"),
    "SA-PY-2": ("print() where a log belongs", "write to a logger"),
    "SA-PY-3": ("TODO, FIXME or HACK left in code", "finish the work or file it elsewhere"),
    "SA-PY-4": ("star import", "import the names that are used"),
    "SA-PY-5": ("has_key(), which no longer exists", "test membership with in"),
    "SA-PY-6": ("comparison with True", "test the value itself"),
    "SA-PY-7": ("comparison of None by ==", "compare with is None"),
    "SA-JS-1": ("console.log left in code", "remove it or use a logger"),
    "SA-JS-2": ("var declaration", "declare with let or const"),
    "SA-JS-3": ("loose equality", "compare with ==="),
    "SEC-RX-1": ("possible SQL injection: formatted statement", "bind values as parameters of the statement"),
    "SEC-RX-2": ("possible SQL injection: SELECT joined by +", "bind values as parameters of the statement"),
    "SEC-RX-3": ("possible SQL injection: f-string statement", "bind values as parameters instead of an f-string"),
    "SEC-RX-4": ("hard-coded key, password or token", "read it from the environment or a secret store"),
    "SEC-RX-5": ("hard-coded cloud key", "use the environment or a role"),
    "SEC-RX-6": ("assignment to innerHTML (XSS)", "set textContent, or escape the value first"),
    "SEC-RX-7": ("document.write() (XSS)", "build elements instead"),
    "SEC-RX-8": ("possible command injection: os.system with a joined string", "run a list of arguments without a shell"),
    "SEC-RX-9": ("possible path traversal: ../ in a call that opens paths", "resolve the path and check that it stays inside"),
    "SEC-RX-10": ("password may reach a log", "leave passwords out of logs"),
    "SEC-RX-11": ("random.random() is no secure generator", "use the secrets module where it matters"),
    "AUD-INJ-1": ("SQL injection: %s in a statement", "bind values as parameters of the statement"),
    "AUD-INJ-2": ("SQL injection: f-string statement", "bind values as parameters of the statement"),
    "AUD-INJ-3": ("SQL injection: statement joined by +", "bind values as parameters of the statement"),
    "AUD-INJ-4": ("SQL injection: rawQuery joined by +", "bind values as parameters of the statement"),
    "AUD-INJ-5": ("command injection: os.system joined by +", "run a list of arguments without a shell"),
    "AUD-INJ-6": ("command injection: subprocess joined by +", "run a list of arguments without a shell"),
    "AUD-INJ-7": ("code injection: eval of a joined string", "do not evaluate text"),
    "AUD-SEN-1": ("exposed secret: hard-coded password", "read it from the environment or a secret store"),
    "AUD-SEN-2": ("exposed secret: hard-coded API key", "read it from the environment or a secret store"),
    "AUD-SEN-3": ("exposed secret: hard-coded token", "read it from the environment or a secret store"),
    "AUD-SEN-4": ("exposed secret: hard-coded AWS key", "read it from the environment or a secret store"),
    "AUD-SEN-5": ("API called over plain HTTP", "use HTTPS"),
    "AUD-XSS-1": ("XSS: assignment to innerHTML", "set textContent, or clean the markup first"),
    "AUD-XSS-2": ("XSS: assignment to outerHTML", "set textContent, or clean the markup first"),
    "AUD-XSS-3": ("XSS: document.write()", "set textContent, or clean the markup first"),
    "AUD-XSS-4": ("XSS: eval of a joined string", "do not evaluate text"),
    "AUD-XSS-5": ("XSS: dangerouslySetInnerHTML", "render text, or clean the markup first"),
    "AUD-DES-1": ("unsafe deserialisation: pickle", "use a data-only format such as JSON"),
    "AUD-DES-2": ("unsafe deserialisation: cPickle", "use a data-only format such as JSON"),
    "AUD-DES-3": ("unsafe deserialisation: dill", "use a data-only format such as JSON"),
    "AUD-DES-4": ("unsafe deserialisation: yaml.load", "use yaml.safe_load"),
    "AUD-DES-5": ("unsafe deserialisation: marshal", "use a data-only format such as JSON"),
    "AUD-LOG-1": ("password may reach a log", "mask sensitive fields before they are logged"),
    "AUD-LOG-2": ("token may reach a log", "mask sensitive fields before they are logged"),
    "AUD-LOG-3": ("secret may reach a log", "mask sensitive fields before they are logged"),
    "AUD-LOG-4": ("credit card data may reach a log", "mask sensitive fields before they are logged"),
    "AUD-LOG-5": ("password may be printed", "mask sensitive fields before they are printed"),
    "AUD-PTH-1": ("path traversal: ../ in code", "resolve the path and check that it stays inside"),
    "AUD-PTH-2": ("path traversal: request joined to a path", "resolve the path and check that it stays inside"),
    "AUD-PTH-3": ("path traversal: request opens a file", "resolve the path and check that it stays inside"),
    "AUD-CRY-1": ("weak hash: MD5", "use SHA-256"),
    "AUD-CRY-2": ("weak hash: SHA-1", "use SHA-256"),
    "AUD-CRY-3": ("weak generator: random.random", "use the secrets module"),
    "AUD-CRY-4": ("weak generator: random.randint", "use the secrets module"),
    "SEC-AST-1": ("eval() or exec() runs text as code", "parse data instead, with ast.literal_eval or the like"),
    "SEC-AST-2": ("unsafe deserialisation", "use JSON or another data-only format"),
    "SEC-AST-3": ("call that runs a command", "use subprocess.run with a list of arguments and no shell"),
    "SEC-AST-4": ("unsafe YAML loading", "use yaml.safe_load"),
    "AUD-ACC-1": ("route without an access check", "require a login or a permission"),
    "AUD-AST-1": ("hard-coded secret: %s", "move %s to the environment or the configuration"),
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    suffixes: tuple[str, ...]
    guard: str
    ignore_case: bool
    needs: tuple[str, ...]
    regex: str
    ordinal: int

    @property
    def group(self) -> str:
        return self.rule_id.rpartition("-")[0]


def _suffixes(name: str) -> tuple[str, ...]:
    return {"py": (".py",), "js": (".js", ".ts"), "web": WEB}.get(name) or SUFFIXES[name]


@lru_cache
def all_rules() -> tuple[Rule, ...]:
    return tuple(Rule(rule_id, severity, _suffixes(kind), guard, ignore_case, needs, regex, i) for i, (rule_id, severity, kind, guard, ignore_case, needs, regex) in enumerate(PATTERNS))


def rules(*prefixes: str) -> tuple[Rule, ...]:
    """The rules whose id begins with one of the prefixes, in catalogue order."""
    return tuple(r for r in all_rules() if r.rule_id.startswith(prefixes))


@lru_cache
def classes() -> dict[str, tuple[str, str]]:
    """Group or rule id -> (OWASP category, CWE)."""
    return {name: (owasp, cwe) for names, owasp, cwe in CLASSES for name in names}


def class_of(rule_id: str) -> tuple[str, str]:
    return classes().get(rule_id) or classes()[rule_id.rpartition("-")[0]]


def facts() -> list[tuple]:
    """(rule_id, severity, ordinal, phase, owasp, cwe, title, advice) of every rule; phase is the check's place in its report."""
    every = [(r.rule_id, r.severity, r.ordinal) for r in all_rules()]
    every += [(k, v[0], i) for i, (k, v) in enumerate(CALLS.items())] + [("AUD-ACC-1", "high", 0), ("AUD-AST-1", "critical", 0)]
    out = []
    for rule_id, severity, ordinal in every:
        group = rule_id.rpartition("-")[0]
        phase = AUDIT_ORDER.index(group) if group in AUDIT_ORDER else {"SA-PY": 0, "SA-JS": 1, "SEC-AST": 0, "SEC-RX": 1}[group]
        out.append((rule_id, severity, ordinal, phase, *class_of(rule_id), *ADVICE[rule_id]))
    return out


FACTS = "rule_id string, severity string, ordinal int, phase int, owasp string, cwe string, title string, advice string"


def catalogue(spark: SparkSession) -> DataFrame:
    """The facts of every rule: a table of fixed size, which callers may extend."""
    return spark.createDataFrame(facts(), FACTS)
