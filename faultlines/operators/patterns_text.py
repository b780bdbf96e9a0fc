"""Regular expressions composed from the fixed values, for use on whole logs.

``H`` is whitespace inside a line, so that a line test applied to a whole log never crosses a newline.
"""

from __future__ import annotations

import re

from faultlines import constants as C

H = r"[^\S\n]"


def _any(literals: list[str]) -> str:
    return "(?:" + "|".join(re.escape(x) for x in literals) + ")"


# --- .NET: a segment is a start line and the continuation lines below it
_SEVERITY = r"(?:error|warning|info|fatal)"
_KNOWN_CODE = rf"{_SEVERITY}{H}+(?:CS|MSB|NU|NETSDK)\d+{H}*:"
_DOTNET_START = (
    rf"(?:(?:[^\n]*{H})?{_KNOWN_CODE}"
    rf"|[^\n]*\([^()\n]*\):{H}*{_KNOWN_CODE}"
    rf"|(?:[^\n]+?{H}*:{H}*)?{_SEVERITY}{H}+[A-Z]{{2,}}\d{{3,7}}{H}*:[^\n]+)"
)
_DOTNET_NOISE = (
    f"(?:{_any(C.DOTNET_NOISE_PREFIXES)}|" + rf"\d+{H}+{_any(C.DOTNET_NOISE_COUNTERS)}\(s\))"
)
_DOTNET_CONTINUED = f"(?:{H}|{_any(C.DOTNET_CONTINUATIONS)})"
DOTNET_SEGMENT = (
    rf"^(?={_DOTNET_START})[^\n]+(?:\n(?!{_DOTNET_START})(?!{_DOTNET_NOISE})(?={_DOTNET_CONTINUED})[^\n]+)*+"
)

# --- TypeScript: blank lines stay inside the segment
TYPESCRIPT_LINE = C.TYPESCRIPT_HEADER.replace(r"\s", H)
_TYPESCRIPT_CONTINUED = rf"(?:{H}|\d|~|{_any([C.TYPESCRIPT_CONTINUATION])})"
TYPESCRIPT_SEGMENT = (
    rf"^(?={TYPESCRIPT_LINE[1:]})[^\n]+(?:\n(?:(?=\n|\z)"
    rf"|(?!{TYPESCRIPT_LINE[1:]})(?!{_any(C.TYPESCRIPT_NOISE_PREFIXES)})(?={_TYPESCRIPT_CONTINUED})[^\n]+))*+"
)

# --- Python: a segment runs from one traceback header to the next
PYTHON_HEADER = re.escape(C.DETECT_PYTHON_MARKER)
_PYTHON_TYPE = (
    r"(?!(?i:traceback))((?:[A-Za-z_][A-Za-z0-9_.]*)?" + _any(C.PYTHON_EXCEPTION_SUFFIXES)
    + "|" + _any(C.PYTHON_OTHER_EXCEPTIONS) + ")"
)
# Groups: text before the exception line, exception type, message. Greedy, so the last such line wins.
PYTHON_EXCEPTION = rf"((?s:.*\n)?){H}*{_PYTHON_TYPE}(?::([^\n]*)|{H}*)(?=\n|\z)"
PYTHON_LAST_LINE_EXCEPTION = rf"(?:^|\n){H}*{_PYTHON_TYPE}(?::[^\n]*)?\z"
PYTHON_FRAME_LINE = rf"^{H}*File \"([^\n]+?)\", line (\d+)(?:, in ([^\n]+))?{H}*$"
PYTHON_LAST_FRAME = rf"(?:(?s:.*\n))?{H}*File \"([^\n]+?)\", line (\d+)(?:, in ([^\n]+?))?{H}*(?=\n|\z)"

# --- npm: lines with an error prefix
_NPM_PREFIX = rf"^{H}*npm{H}+(?:ERR!|error){H}+"
NPM_LINE_CODE = _NPM_PREFIX + r"(ERESOLVE(?= [^\n]*\S)|ENOENT)"
NPM_MESSAGE = _NPM_PREFIX + rf"(?!{H}*{_any(C.NPM_SKIPPED_PREFIXES)})(\S[^\n]*)"

# --- Vite: patterns that begin with a file name start at a line start, which is where the leftmost
# match begins anyway; without the anchor a long line would be tried from every position.
_LINE_START = r"(?:^|(?<=\r))"
VITE_EXPORT_LINE = _LINE_START + C.VITE_EXPORT
VITE_PARSE_LINE = _LINE_START + C.VITE_PARSE
VITE_MESSAGE_LINE = (
    rf"^{H}*(?!{_any(C.VITE_NOISE_PREFIXES)}|{C.VITE_NOISE_MARK})(\S[^\n]*)"
)
