"""Fixed values.

Everything in this module has to keep exactly these values for results to be right: names,
lookup tables, weights, texts and regular expressions that define the log formats. Code that
uses them lives in ``functions`` and ``operators``.
"""

# Limits
MAX_CONTENT_CHARS = 250_000
MAX_SCOPE_CHARS = 200
MAX_TOP_PATTERNS = 100
DEFAULT_TOP_PATTERNS = 10
NARRATIVE_SEARCH_POOL = 250
REDACT_MAX_LENGTH = 240
RAW_RETENTION_DAYS = 7
ANALYSIS_RETENTION_DAYS = 90

# Enumerations
TOOL_KINDS = ["Unknown", "DotNet", "TypeScript", "Npm", "Vite", "Python", "Generic"]
SEVERITIES = ["Unknown", "Info", "Warning", "Error", "Fatal"]
CATEGORIES = [
    "Unknown", "Syntax", "MissingSymbol", "TypeMismatch", "NullableSafety", "Dependency",
    "Configuration", "BuildSystem", "RuntimeEnvironment", "Serialization", "TestFailure",
]
INPUT_TYPES = ["SingleDiagnostic", "BuildLog"]

# Spellings accepted for a tool
TOOL_ALIASES = {
    "dotnet": "DotNet",
    ".net": "DotNet",
    "roslyn": "DotNet",
    "typescript": "TypeScript",
    "ts": "TypeScript",
    "tsc": "TypeScript",
    "npm": "Npm",
    "vite": "Vite",
    "python": "Python",
    "py": "Python",
    "generic": "Generic",
}

# Enumeration value -> public text
TOOL_TEXT = {
    "DotNet": "dotnet",
    "TypeScript": "typescript",
    "Npm": "npm",
    "Vite": "vite",
    "Python": "python",
    "Generic": "generic",
    "Unknown": "unknown",
}
TOOL_FRIENDLY = {
    "DotNet": ".NET",
    "TypeScript": "TypeScript",
    "Npm": "npm",
    "Vite": "Vite",
    "Python": "Python",
    "Generic": "generic",
}
SEVERITY_TEXT = {
    "Info": "info",
    "Warning": "warning",
    "Error": "error",
    "Fatal": "fatal",
    "Unknown": "unknown",
}
CATEGORY_TEXT = {
    "Unknown": "unknown",
    "Syntax": "syntax",
    "MissingSymbol": "missing-symbol",
    "TypeMismatch": "type-mismatch",
    "NullableSafety": "nullable-safety",
    "Dependency": "dependency",
    "Configuration": "configuration",
    "BuildSystem": "build-system",
    "RuntimeEnvironment": "runtime-environment",
    "Serialization": "serialization",
    "TestFailure": "test-failure",
}
INPUT_TYPE_TEXT = {"BuildLog": "build-log", "SingleDiagnostic": "single-diagnostic"}

# Tool detection: markers (case ignored) and patterns, confidence and reason
DETECT_VITE_MARKERS = [
    "[vite]", "vite v", "error during build:", "Rollup failed to resolve import", "is not exported by",
]
DETECT_DOTNET_CODE = r"\b(CS\d{4}|MSB\d{4}|NETSDK\d{4}|NU\d{4})\b"
DETECT_DOTNET_MARKER = "Build FAILED"
DETECT_DOTNET_PROJECT_END = r"\.csproj\]$"
DETECT_TYPESCRIPT_CODE = r"\bTS\d{4}\b"
DETECT_NPM_MARKERS = ["npm ERR!", "npm error", "Missing script:"]
DETECT_PYTHON_MARKER = "Traceback (most recent call last):"
DETECTION = {
    "hint": (1.0, "explicit-tool-hint"),
    "Vite": (0.93, "matched-vite-pattern"),
    "DotNet": (0.97, "matched-dotnet-diagnostic-pattern"),
    "TypeScript": (0.97, "matched-typescript-diagnostic-pattern"),
    "Npm": (0.9, "matched-npm-error-pattern"),
    "Python": (0.95, "matched-python-traceback-pattern"),
    "Unknown": (0.05, "no-tool-pattern-matched"),
}

# Parser selection
PARSER_NAMES = {
    "DotNet": "dotnet-diagnostic-parser-v1",
    "TypeScript": "typescript-diagnostic-parser-v1",
    "Vite": "vite-diagnostic-parser-v1",
    "Npm": "npm-diagnostic-parser-v1",
    "Python": "python-traceback-parser-v1",
}
ACCEPT_DOTNET_MARKERS = [
    " error CS", " warning CS", " error MSB", " error NETSDK", " error NU", " warning NU",
]
ACCEPT_DOTNET_CODE = r"\b(CS|MSB|NETSDK|NU)\d{3,7}\b"
ACCEPT_TYPESCRIPT_MARKERS = [" error TS", " warning TS"]
ACCEPT_TYPESCRIPT_CODE = r"\bTS\d{4,5}\b"
NO_PARSER_UNKNOWN = "No parser could be selected because tool detection returned unknown."
NO_PARSER_TOOL = "No registered parser could handle tool '%s'."

# .NET diagnostics: whole-segment patterns
DOTNET_LOCATED = (
    r"^(.+?)\((\d+),(\d+)(?:,(\d+),(\d+))?\):\s*(error|warning|info|fatal)\s+([A-Z]{2,}\d{3,7})\s*:\s*"
    r"(.+?)(?:\s+\[([^\]]+)\])?$"
)
DOTNET_PLAIN = (
    r"^(?:(.+?)\s*:\s*)?(error|warning|info|fatal)\s+([A-Z]{2,}\d{3,7})\s*:\s*(.+?)(?:\s+\[([^\]]+)\])?$"
)
DOTNET_PROJECT_SUFFIXES = [".csproj", ".props", ".targets", ".sln"]
DOTNET_CONTINUATIONS = ["Additional information:", "See ", "at "]
DOTNET_NOISE_PREFIXES = ["Build ", "Time Elapsed", "Done Building Project"]
DOTNET_NOISE_COUNTERS = ["Warning", "Error"]
DOTNET_SOURCES = [("CS", "Roslyn"), ("MSB", "MSBuild"), ("NU", "NuGet"), ("NETSDK", ".NET SDK")]
DOTNET_SOURCE_DEFAULT = ".NET"

# TypeScript diagnostics
TYPESCRIPT_HEADER = (
    r"^(.+?)(?::|\()(\d+)(?:,|:)(\d+)\)?\s*(?:-|:)\s*(error|warning)\s+(TS\d{4,5})\s*:\s*(.+)$"
)
TYPESCRIPT_NOISE_PREFIXES = ["Found ", "error Command failed", "npm ERR!"]
TYPESCRIPT_CONTINUATION = "Did you mean"

# Python tracebacks
PYTHON_EXCEPTION_SUFFIXES = ["Error", "Exception", "Warning"]
PYTHON_OTHER_EXCEPTIONS = [
    "SystemExit", "KeyboardInterrupt", "GeneratorExit", "StopIteration", "StopAsyncIteration",
]
PYTHON_CARET_EXCEPTIONS = ["SyntaxError", "IndentationError", "TabError"]
PYTHON_CARET_LINES = 4

# npm logs
NPM_MISSING_SCRIPT = r"^npm\s+(?:ERR!|error)\s+Missing\s+script:\s+\"?([^\"\r\n]+)\"?\s*$"
NPM_CODE = r"^npm\s+(?:ERR!|error)\s+code\s+([A-Z0-9_]+)\s*$"
NPM_PATH = r"^npm\s+(?:ERR!|error)\s+path\s+(.+?)\s*$"
NPM_PACKAGE_JSON = (
    r"Could\s+not\s+read\s+package\.json:\s+Error:\s+ENOENT:.*?(?:'|\")([^'\"\r\n]*package\.json)(?:'|\")"
)
NPM_SKIPPED_PREFIXES = [
    "code ", "path ", "errno ", "cwd ", "syscall ", "A complete log", "This is related to npm",
]
NPM_DEFAULT_CODE = "NPM_BUILD_ERROR"
NPM_DEFAULT_MESSAGE = "npm command failed"

# Vite logs
VITE_IMPORT = r"(?:\[vite\]\s*:\s*)?Rollup\s+failed\s+to\s+resolve\s+import\s+\"([^\"]+)\"\s+from\s+\"([^\"]+)\"\.?"
VITE_EXPORT = (
    r"([^\r\n]+?)\s*\((\d+):(\d+)\):\s*\"([^\"]+)\"\s+is\s+not\s+exported\s+by\s+\"([^\"]+)\""
    r"(?:,\s*imported\s+by\s+\"([^\"]+)\")?\."
)
VITE_PARSE = r"([^\r\n]+?)\s*\((\d+):(\d+)\):\s*((?:Unexpected|Expected|Unterminated).+)$"
VITE_FILE = r"^file:\s*(.+?)(?::(\d+):(\d+))?\s*$"
VITE_NOISE_PREFIXES = ["vite v", "transforming", "x Build failed", "error during build:", "at ", "file:"]
VITE_NOISE_MARK = "✓"

# Message templates: (code or None, pattern, ignore case, replacement)
DOTNET_TEMPLATES = [
    (r"'[^']+'", "'{identifier}'"),
    (r"\"[^\"]+\"", "\"{string}\""),
]
TYPESCRIPT_TEMPLATES = [
    (r"^Cannot find name '[^']+'\.$", "Cannot find name '{identifier}'."),
    (r"^Cannot find namespace '[^']+'\.$", "Cannot find namespace '{identifier}'."),
    (
        r"^Cannot find module '[^']+'((?: or its corresponding type declarations)?\.)$",
        "Cannot find module '{module}'$1",
    ),
    (r"^Property '[^']+' does not exist on type '[^']+'\.$", "Property '{identifier}' does not exist on type '{type}'."),
    (r"^Type '.+?' is not assignable to type '.+?'\.$", "Type '{type}' is not assignable to type '{type}'."),
    (
        r"^Argument of type '.+?' is not assignable to parameter of type '.+?'\.$",
        "Argument of type '{type}' is not assignable to parameter of type '{type}'.",
    ),
]
PYTHON_TEMPLATES = {
    "NameError": (r"^name\s+'[^']+'\s+is\s+not\s+defined$", "name '{identifier}' is not defined"),
    "UnboundLocalError": (
        r"^local\s+variable\s+'[^']+'\s+referenced\s+before\s+assignment$",
        "local variable '{identifier}' referenced before assignment",
    ),
    "ModuleNotFoundError": (r"^No\s+module\s+named\s+'[^']+'$", "No module named '{module}'"),
    "ImportError": (
        r"^cannot\s+import\s+name\s+'[^']+'\s+from\s+'[^']+'.*$",
        "cannot import name '{identifier}' from '{module}'",
    ),
    "AttributeError": (
        r"^'[^']+'\s+object\s+has\s+no\s+attribute\s+'[^']+'$",
        "'{type}' object has no attribute '{attribute}'",
    ),
    "TypeError": (r"^'[^']+'\s+object\s+is\s+.+$", "'{type}' object is {operation}"),
    "FileNotFoundError": (
        r"^\[Errno\s+\d+\]\s+No\s+such\s+file\s+or\s+directory:\s+'[^']+'$",
        "[Errno {number}] No such file or directory: '{path}'",
    ),
}
PYTHON_QUOTED_PATH = r"'(?:(?:[A-Za-z]:)?[/\\][^'\r\n]+|\.?\.?[/\\][^'\r\n]+)'"
PYTHON_INTEGER = r"\b\d+\b"
PYTHON_QUOTED_REST = r"'(?!\{(?:identifier|module|path|type|attribute)\})[^'\r\n]+'"
JAVASCRIPT_TEMPLATES = {
    "VITE_RESOLVE_IMPORT": (
        r"Rollup\s+failed\s+to\s+resolve\s+import\s+\"[^\"]+\"\s+from\s+\"[^\"]+\"\.",
        "Rollup failed to resolve import '{import}' from '{file}'.",
    ),
    "VITE_MISSING_EXPORT": (
        r"\"[^\"]+\"\s+is\s+not\s+exported\s+by\s+\"[^\"]+\".*",
        "Export '{symbol}' is not provided by '{module}'.",
    ),
    "VITE_PARSE_ERROR": (r"Unexpected\s+token.*\sin\s+\"[^\"]+\"", "Unexpected token in '{file}'."),
    "NPM_MISSING_SCRIPT": (r"Missing\s+script:\s+\"[^\"]+\"", "Missing script '{script}'."),
    "ERESOLVE": (
        r"ERESOLVE\s+unable\s+to\s+resolve\s+dependency\s+tree",
        "unable to resolve dependency tree",
    ),
    "ENOENT": (
        r"Could\s+not\s+read\s+package\.json.*?(?:'|\")(?:(?:[A-Za-z]:)?[/\\][^'\"\r\n]*package\.json)(?:'|\")",
        "Could not read package.json at '{path}'.",
    ),
}
JAVASCRIPT_QUOTED_PATH = (
    r"'(?:(?:[A-Za-z]:)?[/\\][^'\r\n]+|\.\.?[/\\][^'\r\n]+)'"
    r"|\"(?:(?:[A-Za-z]:)?[/\\][^\"\r\n]+|\.\.?[/\\][^\"\r\n]+)\""
)

# Categories by code, then by text found in the normalised message (first hit wins)
DOTNET_CODE_PREFIX_CATEGORY = [("MSB", "BuildSystem"), ("NETSDK", "BuildSystem"), ("NU", "Dependency")]
DOTNET_CODE_CATEGORY = {
    "CS0246": "Dependency",
    "CS0234": "Dependency",
    "CS0103": "MissingSymbol",
    "CS8618": "NullableSafety",
}
DOTNET_TEXT_CATEGORY = [("does not exist in the current context", "MissingSymbol")]
TYPESCRIPT_CODE_CATEGORY = {
    "TS2304": "MissingSymbol",
    "TS2552": "MissingSymbol",
    "TS2503": "MissingSymbol",
    "TS2339": "MissingSymbol",
    "TS2307": "Dependency",
    "TS2322": "TypeMismatch",
    "TS2345": "TypeMismatch",
    "TS2741": "TypeMismatch",
    "TS1005": "Syntax",
    "TS1109": "Syntax",
    "TS1128": "Syntax",
}
TYPESCRIPT_TEXT_CATEGORY = [
    ("Cannot find name", "MissingSymbol"),
    ("Cannot find namespace", "MissingSymbol"),
    ("does not exist on type", "MissingSymbol"),
    ("Cannot find module", "Dependency"),
    ("type declarations", "Dependency"),
    ("is not assignable to type", "TypeMismatch"),
]
PYTHON_CODE_CATEGORY = {
    "SyntaxError": "Syntax",
    "IndentationError": "Syntax",
    "TabError": "Syntax",
    "NameError": "MissingSymbol",
    "UnboundLocalError": "MissingSymbol",
    "AttributeError": "MissingSymbol",
    "ModuleNotFoundError": "Dependency",
    "ImportError": "Dependency",
    "TypeError": "TypeMismatch",
    "ValueError": "TypeMismatch",
    "AssertionError": "TestFailure",
    "FileNotFoundError": "RuntimeEnvironment",
    "PermissionError": "RuntimeEnvironment",
    "OSError": "RuntimeEnvironment",
    "RuntimeError": "RuntimeEnvironment",
    "KeyError": "RuntimeEnvironment",
    "IndexError": "RuntimeEnvironment",
    "ZeroDivisionError": "RuntimeEnvironment",
}
PYTHON_TEXT_CATEGORY = [
    ("not defined", "MissingSymbol"),
    ("has no attribute", "MissingSymbol"),
    ("No module named", "Dependency"),
    ("cannot import name", "Dependency"),
    ("invalid syntax", "Syntax"),
    ("expected an indented block", "Syntax"),
    ("No such file or directory", "RuntimeEnvironment"),
    ("Permission denied", "RuntimeEnvironment"),
]
JAVASCRIPT_CODE_CATEGORY = {
    "VITE_RESOLVE_IMPORT": "Dependency",
    "VITE_MISSING_EXPORT": "MissingSymbol",
    "VITE_PARSE_ERROR": "Syntax",
    "NPM_MISSING_SCRIPT": "Configuration",
    "ERESOLVE": "Dependency",
    "ENOENT": "Configuration",
    "ELIFECYCLE": "BuildSystem",
    "ERR_MODULE_NOT_FOUND": "Dependency",
}
JAVASCRIPT_TEXT_CATEGORY = [
    ("failed to resolve import", "Dependency"),
    ("dependency tree", "Dependency"),
    ("module not found", "Dependency"),
    ("not exported by", "MissingSymbol"),
    ("not provided by", "MissingSymbol"),
    ("Unexpected token", "Syntax"),
    ("Expected", "Syntax"),
    ("Unterminated", "Syntax"),
    ("Missing script", "Configuration"),
    ("package.json", "Configuration"),
    ("command failed", "BuildSystem"),
    ("lifecycle", "BuildSystem"),
    ("error during build", "BuildSystem"),
]

# Named fingerprints: (tool, code upper-cased, category or None, text in message or None, fingerprint)
CANONICAL_FINGERPRINTS = [
    ("DotNet", "CS0103", "MissingSymbol", None, "fp_cs0103_name_missing"),
    ("DotNet", "CS8618", "NullableSafety", None, "fp_cs8618_non_nullable_uninitialized"),
    ("TypeScript", "TS2304", "MissingSymbol", None, "fp_ts2304_name_missing"),
    ("Python", "NAMEERROR", None, "name '{identifier}' is not defined", "fp_python_nameerror_not_defined"),
]
UNKNOWN_FINGERPRINT = "fp_unknown"

# Ranking weights
SEVERITY_SCORE = {"Fatal": 400, "Error": 300, "Warning": 200, "Info": 100}
SEVERITY_WEIGHT = {"Fatal": 0.95, "Error": 0.85, "Warning": 0.45, "Info": 0.2}
SEVERITY_WEIGHT_DEFAULT = 0.1
CATEGORY_BOOST = {"MissingSymbol": 0.08, "Dependency": 0.08, "BuildSystem": 0.06, "NullableSafety": 0.03}
CATEGORY_BOOST_DEFAULT = 0.02
CODE_BOOST = {"CS0103": 0.05, "CS0246": 0.05, "CS0234": 0.05}
REPEAT_BOOST_STEP, REPEAT_BOOST_MAX = 0.02, 0.08
PARSE_BOOST_FACTOR, PARSE_BOOST_MAX = 0.1, 0.1
CONFIDENCE_MAX = 0.99
GROUP_REASON_SINGLE = "single-primary-diagnostic"
GROUP_REASON_MANY = "exact-fingerprint-dedupe"

# Insight texts: key -> (title, explanation, three causes, three fixes)
INSIGHTS_BY_CODE = {
    "CS0103": (
        "Unknown symbol in current context",
        "The compiler cannot resolve a referenced name in the current scope.",
        ["Typo in variable or member name", "Missing declaration", "Wrong scope or missing using/reference"],
        [
            "Check the symbol name for a typo.",
            "Verify the symbol is declared before use.",
            "Confirm the intended variable or member is available in this scope.",
        ],
    ),
    "TS2304": (
        "Unknown identifier in TypeScript context",
        "TypeScript cannot resolve a referenced identifier in the current file or scope.",
        ["Typo in identifier name", "Variable not declared", "Import missing or incorrect"],
        [
            "Check the identifier spelling for a typo.",
            "Verify the symbol is declared before use.",
            "Confirm the symbol is imported or exported from the expected module.",
        ],
    ),
    "TS2307": (
        "Missing TypeScript module or declarations",
        "TypeScript could not resolve the referenced module path or its type declarations.",
        [
            "Import path points to the wrong file",
            "Package or local module is missing",
            "Type declarations are unavailable for the imported package",
        ],
        [
            "Verify the import path points to a real file or package.",
            "Check tsconfig path aliases and module resolution settings.",
            "Install or add the missing package or type declarations if needed.",
        ],
    ),
}
INSIGHTS_BY_CATEGORY = {
    "MissingSymbol": (
        "Missing or unresolved symbol",
        "A referenced symbol could not be resolved by the tool in the current context.",
        [
            "Typo in referenced symbol",
            "Missing declaration or import",
            "Wrong scope or unavailable project reference",
        ],
        [
            "Check the spelling of the referenced symbol.",
            "Verify the symbol is declared or imported.",
            "Confirm the symbol is available in the current scope or project.",
        ],
    ),
    "NullableSafety": (
        "Nullable safety issue",
        "The compiler found a nullable-reference-safety issue that may lead to invalid null handling.",
        [
            "Member not initialized before constructor exit",
            "Nullability annotation does not match runtime behavior",
            "Required/init pattern is missing where the type expects it",
        ],
        [
            "Initialize the member before constructor exit.",
            "Mark the member nullable if null is expected.",
            "Use required/init patterns if they fit the design.",
        ],
    ),
    "Dependency": (
        "Dependency or reference problem",
        "The build depends on a missing or unresolved package, assembly, or referenced type.",
        [
            "Package, assembly, or project reference is missing",
            "Namespace or import is incorrect",
            "Restore/build state is out of sync",
        ],
        [
            "Verify package and project references.",
            "Check namespaces and imports/usings.",
            "Confirm restore/build ran against the expected solution state.",
        ],
    ),
    "BuildSystem": (
        "Build system failure",
        "The toolchain failed at the build-system layer rather than in user code semantics.",
        [
            "Locked file or output path issue",
            "Bad build target or configuration",
            "Stale build artifacts are interfering with the current build",
        ],
        [
            "Read the build-system message for locked files or invalid targets.",
            "Close any process using the locked output if file access is blocked.",
            "Rebuild after clearing stale build artifacts if necessary.",
        ],
    ),
}
INSIGHT_DEFAULT = (
    "Build diagnostic detected",
    "The system extracted a structured diagnostic, but no specialized explanation has been added yet.",
    [
        "The earliest high-severity diagnostic is the most likely starting point",
        "A configuration or code issue may be causing downstream noise",
        "This pattern needs a specialized explainer once it repeats",
    ],
    [
        "Inspect the diagnostic code and file location first.",
        "Fix the earliest high-severity diagnostic before downstream noise.",
        "Add a specialized rule or explainer once this pattern repeats.",
    ],
)

# Single-diagnostic view without a candidate
SINGLE_DEFAULT_EXPLANATION = (
    "A structured diagnostic was detected, but no specialized explanation is available yet."
)
SINGLE_CAUSES_BY_CATEGORY = {
    "MissingSymbol": INSIGHTS_BY_CATEGORY["MissingSymbol"][2],
    "NullableSafety": [
        "Member not initialized before constructor exit",
        "Nullability annotation does not match runtime behavior",
        "Required/init pattern missing where expected",
    ],
    "Dependency": INSIGHTS_BY_CATEGORY["Dependency"][2],
    "BuildSystem": [
        "Locked file or output path issue",
        "Bad build target or configuration",
        "Stale build artifacts interfering with compilation",
    ],
}

# Narrative texts
NARRATIVE_NOISE = "Warnings are likely downstream noise unless they block the same area as the primary error."
NARRATIVE_NO_TITLE = "Grouped issue"
NARRATIVE_NO_SECONDARY = "other follow-on issues"
NARRATIVE_DEFAULT_STEPS = [
    "Start with the earliest high-confidence root cause candidate.",
    "Resolve repeated fingerprint groups before chasing downstream noise.",
    "Re-run the build after the first substantive fix to confirm what remains.",
]

# Rules
PRIMARY_MARK_BONUS = 0.10
RELATED_RULE_WEIGHTS = {
    "fingerprint": 120,
    "tool": 10,
    "code": 50,
    "severity": 12,
    "category": 30,
    "message-regex": 35,
    "file-path-regex": 15,
    "projectName": 18,
    "repository": 18,
}
RELATED_RULE_LIMIT = 5

# Patterns
PATTERN_TITLE_PLAIN = "Observed recurring diagnostic pattern"
PATTERN_TITLE_CODE = "Recurring %s diagnostic"

# Similarity
SIM_FINGERPRINT, SIM_CODE, SIM_CATEGORY, SIM_TOKENS = 0.72, 0.55, 0.15, 0.25
SIM_CAP, SIM_THRESHOLD = 0.96, 0.45
TOKEN_SEPARATORS = " \t\r\n,.:;/\\-_()[]{}'\"`"
TOKEN_MIN_LENGTH = 3
SIM_SUMMARY_PREFIX = {
    "fingerprint": "Exact fingerprint match from persisted analysis history.",
    "diagnostic-code": "Similar persisted diagnostic matched by diagnostic code.",
    "message-similarity": "Similar persisted diagnostic from analysis history.",
}

# Narrative search fields and weights, in order
SEARCH_FIELDS = [
    ("summary", 40),
    ("groupSummaries", 25),
    ("recommendedNextSteps", 20),
    ("reason", 15),
    ("projectName", 10),
    ("repository", 10),
    ("provider", 5),
    ("model", 5),
]
SNIPPET_RADIUS, SNIPPET_FALLBACK = 60, 140

# Official documentation: (tool, code or category, id, title, summary, url, tags)
DOCS_BY_CODE = [
    ("DotNet", "CS0103", "official:dotnet:CS0103", "Compiler Error CS0103",
     "Microsoft Learn reference for unresolved names in the current C# scope.",
     "https://learn.microsoft.com/en-us/dotnet/csharp/language-reference/compiler-messages/cs0103",
     ["dotnet", "csharp", "CS0103"]),
    ("DotNet", "CS0246", "official:dotnet:CS0246", "Resolve missing assembly and namespace references",
     "Microsoft Learn guidance covering missing type or namespace reference errors including CS0246.",
     "https://learn.microsoft.com/en-us/dotnet/csharp/language-reference/compiler-messages/assembly-references",
     ["dotnet", "csharp", "CS0246"]),
    ("DotNet", "CS8602", "official:dotnet:CS8602", "Resolve nullable warnings",
     "Microsoft Learn guidance for nullable-reference warnings including CS8602 and CS8618.",
     "https://learn.microsoft.com/en-us/dotnet/csharp/nullable-warnings",
     ["dotnet", "csharp", "CS8602", "nullable"]),
    ("DotNet", "CS8618", "official:dotnet:CS8618", "Resolve nullable warnings",
     "Microsoft Learn guidance for nullable-reference warnings including CS8602 and CS8618.",
     "https://learn.microsoft.com/en-us/dotnet/csharp/nullable-warnings",
     ["dotnet", "csharp", "CS8618", "nullable"]),
    ("TypeScript", "TS2307", "official:typescript:TS2307", "TypeScript module resolution",
     "Official TypeScript module resolution documentation for unresolved imports and module path issues.",
     "https://www.typescriptlang.org/docs/handbook/module-resolution.html",
     ["typescript", "TS2307", "module-resolution"]),
    ("TypeScript", "TS2322", "official:typescript:TS2322", "TypeScript type compatibility",
     "Official TypeScript handbook guidance for incompatible assignment and structural type issues.",
     "https://www.typescriptlang.org/docs/handbook/type-compatibility.html",
     ["typescript", "TS2322", "type-compatibility"]),
    ("TypeScript", "TS2304", "official:typescript:TS2304", "TypeScript modules and symbol resolution",
     "Official TypeScript handbook guidance for finding unresolved names and import resolution problems.",
     "https://www.typescriptlang.org/docs/handbook/2/modules.html",
     ["typescript", "TS2304", "modules"]),
    ("Npm", "NPM_MISSING_SCRIPT", "official:npm:missing-script", "npm package.json scripts",
     "Official npm documentation for defining and running package.json scripts.",
     "https://docs.npmjs.com/cli/v11/configuring-npm/package-json",
     ["npm", "scripts", "package.json"]),
    ("Vite", "VITE_RESOLVE_IMPORT", "official:vite:resolve-import", "Vite resolve.alias shared options",
     "Official Vite configuration reference for alias and import-resolution behavior.",
     "https://vite.dev/config/shared-options",
     ["vite", "imports", "resolve.alias"]),
] + [
    ("Python", code, "official:python:" + code, "Python built-in exceptions",
     "Official Python exception reference covering common import and name-resolution errors.",
     "https://docs.python.org/3.12/library/exceptions.html",
     ["python", code])
    for code in ("NAMEERROR", "UNBOUNDLOCALERROR", "MODULENOTFOUNDERROR", "IMPORTERROR")
]
DOCS_BY_CATEGORY = [
    ("DotNet", "Dependency", "official:dotnet:dependency", "Resolve missing assembly and namespace references",
     "Microsoft Learn guidance for missing assembly, package, and namespace reference issues.",
     "https://learn.microsoft.com/en-us/dotnet/csharp/language-reference/compiler-messages/assembly-references",
     ["dotnet", "dependency"]),
    ("DotNet", "NullableSafety", "official:dotnet:nullable", "Resolve nullable warnings",
     "Microsoft Learn guidance for C# nullable-reference analysis warnings.",
     "https://learn.microsoft.com/en-us/dotnet/csharp/nullable-warnings",
     ["dotnet", "nullable"]),
    ("TypeScript", "Dependency", "official:typescript:dependency", "TypeScript module resolution",
     "Official TypeScript documentation for resolving module lookup and import path issues.",
     "https://www.typescriptlang.org/docs/handbook/module-resolution.html",
     ["typescript", "dependency"]),
    ("TypeScript", "TypeMismatch", "official:typescript:type-mismatch", "TypeScript type compatibility",
     "Official TypeScript documentation for structural compatibility and assignment issues.",
     "https://www.typescriptlang.org/docs/handbook/type-compatibility.html",
     ["typescript", "type-mismatch"]),
    ("Npm", "Configuration", "official:npm:configuration", "npm package.json scripts",
     "Official npm guidance for script configuration and package.json behavior.",
     "https://docs.npmjs.com/cli/v11/configuring-npm/package-json",
     ["npm", "configuration"]),
    ("Vite", "Dependency", "official:vite:dependency", "Vite shared resolve options",
     "Official Vite configuration reference for aliasing and dependency resolution behavior.",
     "https://vite.dev/config/shared-options",
     ["vite", "dependency"]),
    ("Python", "MissingSymbol", "official:python:missing-symbol", "Python built-in exceptions",
     "Official Python exception reference for name and import lookup failures.",
     "https://docs.python.org/3.12/library/exceptions.html",
     ["python", "missing-symbol"]),
]
DOCS_LIMIT = 4
KNOWLEDGE_CODES, KNOWLEDGE_MESSAGES, KNOWLEDGE_FINGERPRINTS = 4, 4, 6
KNOWLEDGE_RULES, KNOWLEDGE_PATTERNS, KNOWLEDGE_PRIOR, KNOWLEDGE_SIMILAR = 3, 4, 3, 3
KNOWLEDGE_SIMILAR_GATE, KNOWLEDGE_LIMIT = 8, 12
KNOWLEDGE_KIND_ORDER = {"official-doc": 0, "rule": 1, "recurring-pattern": 2, "prior-analysis": 3}
KNOWLEDGE_RULE_DEFAULT = "Matched internal rule guidance is available for this diagnostic pattern."
KNOWLEDGE_PATTERN_ONCE = "This diagnostic fingerprint has been observed before in persisted analysis history."

# Redaction for log lines: (text without which the pattern cannot match, pattern, replacement), in order
LOG_SECRET = (
    r"(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|token|secret|password)\b\s*[:=]\s*([^\s,;]+)",
    "$1=<redacted>",
)
LOG_REDACTIONS = [
    ("bearer", r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer <redacted>"),
    ("http", r"https?://[^\s\"']+", "<redacted:url>"),
    ("\\", r"(?:[a-zA-Z]:\\|\\\\)[^\s\"']+", "<redacted:path>"),
    ("/", r"(?<!\w)/(?:[^/\s\"']+/)+[^/\s\"']+", "<redacted:path>"),
    ("@", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "<redacted:email>"),
]
# Redaction for stored raw content: the same form; the secret comes last
RAW_REDACTIONS = [
    ("http", r"(?i)https?://\S+", "[redacted-url]"),
    (":\\", r"\b[A-Za-z]:\\(?:[^\s:;\"'<>|]+\\)*[^\s:;\"'<>|]*", "[redacted-path]"),
    ("/", r"(?<![A-Za-z0-9_\-])/(?:[^\s/]+/)*[^\s/:]+", "[redacted-path]"),
    ("@", r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[redacted-email]"),
    ("bearer", r"(?i)Bearer\s+[A-Za-z0-9._\-+/=]+", "Bearer [redacted-token]"),
]
RAW_SECRET = r"(?i)\b(?:(token)|(secret|password|api[_-]?key))\b\s*[:=]\s*([^\s,;]+)"
RAW_SECRET_TOKEN, RAW_SECRET_OTHER = "[redacted-token]", "[redacted-secret]"

# Enrichment
ENRICH_FEATURE, NARRATIVE_FEATURE = "explanation-enrichment", "root-cause-narrative"
ENRICH_FALLBACK_WARNING = (
    "AI explanation enrichment was requested but could not be completed. "
    "Deterministic analysis was returned instead."
)
NARRATIVE_FALLBACK_WARNING = (
    "AI root-cause narrative generation was requested but could not be completed. "
    "Deterministic narrative was returned instead."
)
ENRICH_SKIPPED = "No eligible root cause candidate was available for AI enrichment."
NARRATIVE_SKIPPED = "No grouped build-log narrative target was available."
