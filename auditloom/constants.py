"""They must equal what existing audit configurations expect, in this order."""

# Secret patterns in order of application: name, pattern in ECMAScript syntax, case-insensitive or not.
SECRET_PATTERNS = (
    ("AWS Access Key ID", r"(?<![A-Za-z0-9/+=])AKIA[0-9A-Z]{16}(?![A-Za-z0-9/+=])", False),
    ("AWS Secret Access Key", r"""(?:aws_secret_access_key|aws_secret_key|AWS_SECRET_ACCESS_KEY)\s*[=:]\s*["']?([A-Za-z0-9/+=]{40})["']?""", True),
    ("Google Cloud API Key", r"AIza[0-9A-Za-z_-]{35}", False),
    ("Google OAuth Client Secret", r"""(?:client_secret|GOOGLE_CLIENT_SECRET)\s*[=:]\s*["']?([A-Za-z0-9_-]{24,})["']?""", True),
    ("PEM Private Key", r"-----BEGIN\s(?:RSA\s)?PRIVATE\sKEY-----[\s\S]*?-----END\s(?:RSA\s)?PRIVATE\sKEY-----", False),
    ("PEM Certificate (private)", r"-----BEGIN\sEC\sPRIVATE\sKEY-----[\s\S]*?-----END\sEC\sPRIVATE\sKEY-----", False),
    ("Database Connection String (URI)", r"""(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|mssql|redis|amqp|rabbitmq):\/\/[^\s'"}{)]+""", True),
    ("Database Connection String (env)", r"""(?:DATABASE_URL|DB_CONNECTION|MONGO_URI|REDIS_URL|DATABASE_URI)\s*[=:]\s*["']?[^\s'"]+["']?""", True),
    ("Bearer Token", r"Bearer\s+[A-Za-z0-9_\-.~+/]+=*", False),
    ("Generic API Key assignment", r"""(?:api[_-]?key|api[_-]?secret|access[_-]?token|auth[_-]?token|secret[_-]?key|private[_-]?key|encryption[_-]?key)\s*[=:]\s*["']([A-Za-z0-9_\-./+=]{16,})["']""", True),
    ("Generic Secret env variable", r"""(?:SECRET|TOKEN|PASSWORD|CREDENTIAL|AUTH)[A-Z_]*\s*[=:]\s*["']([^"']{8,})["']""", True),
    ("JSON Web Token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", False),
    ("GitHub Personal Access Token", r"ghp_[A-Za-z0-9]{36}", False),
    ("GitHub OAuth Access Token", r"gho_[A-Za-z0-9]{36}", False),
    ("GitLab Token", r"glpat-[A-Za-z0-9_-]{20,}", False),
    ("Slack Webhook / Token", r"xox[bpors]-[0-9]{10,}-[A-Za-z0-9-]+", False),
    ("Stripe Secret Key", r"sk_(?:live|test)_[A-Za-z0-9]{24,}", False),
)
MARKER = "<REDACTED_SECRET>"
# For each pattern above, in order: one of these stands in every match, in lower case where the pattern ignores case.
SECRET_LITERALS = (
    ("AKIA",),
    ("aws_secret",),
    ("AIza",),
    ("client_secret",),
    ("-----BEGIN",),
    ("-----BEGIN",),
    ("://",),
    ("database_ur", "db_connection", "mongo_uri", "redis_url"),
    ("Bearer",),
    ("key", "secret", "token"),
    ("secret", "token", "password", "credential", "auth"),
    ("eyJ",),
    ("ghp_",),
    ("gho_",),
    ("glpat-",),
    ("xox",),
    ("sk_live_", "sk_test_"),
)

# Suspicious keywords, in order.
KEYWORDS = ("password", "passwd", "secret", "credential", "private_key", "privatekey", "access_token", "accesstoken", "api_key", "apikey", "auth_token", "authtoken", "encryption_key", "master_key", "signing_key")

# Extensions that may be audited.
ALLOWED_EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "mjs", "cjs", "json", "yaml", "yml", "toml", "py", "pyi", "go", "rs", "c", "h", "cpp", "hpp", "cc", "hh", "cxx", "java", "kt", "kts", "cs", "rb", "php", "swift",
    "sh", "bash", "zsh", "dart", "ex", "exs", "erl", "scala", "lua", "sql", "md", "mdx", "html", "htm", "css", "scss", "sass", "less", "vue", "svelte", "graphql", "gql", "proto", "tf", "hcl",
)
# File name patterns that are never audited.
BLOCKED_PATTERNS = (
    ".env", ".env.*", ".env.local", ".env.development", ".env.production", ".env.staging", ".env.test", "*.pem", "*.key", "*.cert", "*.crt", "*.p12", "*.pfx", "*.jks", "*.keystore",
    "id_rsa", "id_rsa.pub", "id_ed25519", "id_ed25519.pub", "id_dsa", "id_ecdsa", "*.pub", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", "Pipfile.lock",
    "poetry.lock", "Cargo.lock", "go.sum", "*.min.js", "*.min.css", "*.map", "*.chunk.js", "*.bundle.js", ".npmrc", ".pypirc", ".netrc", ".htpasswd", "credentials.json", "service-account*.json",
    "firebase-adminsdk*.json", "*.tfstate", "*.tfstate.backup", "terraform.tfvars", "*.sqlite", "*.sqlite3", "*.db", "*.bak", ".DS_Store", "Thumbs.db", "*.swp", "*.swo",
)
# Directories that are never walked.
BLOCKED_DIRECTORIES = (
    "node_modules", ".git", ".hg", ".svn", "dist", "build", "out", ".next", ".nuxt", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".venv", "venv", "vendor", "target", ".gradle",
    ".idea", ".vscode", "coverage", ".nyc_output", ".turbo", ".cache", "tmp",
)
# Source extensions of commits, and extensions of code files.
GIT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "cs", "go", "java", "rs", "kt", "swift")
CODE_EXTENSIONS = (*GIT_EXTENSIONS, "cpp", "c", "h", "hpp", "rb", "php")

MAX_FILE_BYTES = 512_000
MAX_FILES, MAX_DIFF_LINES, MAX_CHARS_PER_FILE = 15, 1200, 12_000
FLOOR_FILES, FLOOR_DIFF_LINES, FLOOR_CHARS = 1, 100, 1000
TOKEN_LIMITS = {"gemini": 1_000_000, "openai": 128_000, "anthropic": 200_000}
# Models that providers are asked for by default.
DEFAULT_MODELS = {"gemini": "gemini-2.5-flash", "openai": "gpt-4o", "anthropic": "claude-sonnet-4.5"}
DEFAULT_TOKEN_LIMIT, WARN_SHARE = 100_000, 0.8
RETRY_ATTEMPTS, RETRY_BASE_MS, RETRY_CAP_MS, RETRY_JITTER_MS = 3, 500, 10_000, 100
SKILLS_TTL_MS, SKILLS_TOP, SKILL_CHARS = 3_600_000, 8, 280
RULES_MOST, SYNTHETIC_LINES, CONTEXT_CHARS = 20, 400, 120

# Reasons and messages.
IGNORED, NOT_ALLOWED, BLOCKED = "ignored (.gitignore / .archignore)", "extension not in allowlist", "blocked (sensitive file)"
NO_DIFF, BINARY, NO_CHANGE = "No textual diff content", "Binary diff skipped", "No changed lines in patch"
PARSE_FAILED, BAD_FORMAT = "Failed to parse AI response", "Invalid AI response format"
SEVERITIES = ("CRITICAL", "WARNING", "INFO")
STATUSES = ("PASS", "FAIL", "ERROR")

# Labels of reports: fixed values, as readers of existing reports know them, in order.
MARKDOWN_HEAD = ("# Review Report", "- Status: **", "- Target: `", "- AI Enabled: `", "- Generated At: `", "## Summary", "| Metric | Value |", "| --- | --- |")
MARKDOWN_METRICS = ("Total files", "Audited files", "Passed files", "Failed files", "Critical issues", "Warning issues", "Info issues", "Duration (ms)", "Diff lines")
MARKDOWN_PARTS = ("## Skipped Files", "## Findings", "## Runtime Errors")
CONSOLE_HEAD = ("📊 Review Summary", "   Status:         ", "   Target:         ", "   AI Enabled:     ")
CONSOLE_METRICS = ("Total files:    ", "Audited files:  ", "✅ Passed:       ", "❌ Failed:       ", "🚨 Critical:     ", "⚠️  Warning:      ", "ℹ️  Info:         ", "⏱️  Duration:     ", "🔢 Diff lines:   ")
UNKNOWN_ERROR = "Unknown runtime error"

# Our own values.
TRUNCATED = "\n\n# [truncated by maxCharsPerFile]"
