"""Regular expressions built from the phrase lists in ``trackwise.fixed``. Names and roles are read token by token
(``functions.reading``).

Two dialects are produced from the same lists: ``java`` (Spark's ``rlike`` /
``regexp_*``) and ``re2`` (DuckDB, used as the independent oracle). They differ
only where the engines differ:

* Java's ``\\b`` is Unicode-aware, RE2's is ASCII: Spark gets an explicit ASCII
  word-boundary construct.
* Java's ``$`` also matches before a final newline: both dialects use ``\\z``.
"""

from __future__ import annotations

from trackwise import fixed

_META = set(".^$*+?()[]{}|\\")

# one shared whitespace class: what a JavaScript trim()/\s removes, written so
# that Java and RE2 read it identically
WS = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: the same class as plain characters
WS_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# ASCII word boundary for Java (Java's \b also treats non-ASCII letters as word chars)
_JAVA_WB = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def wb(dialect: str) -> str:
    return _JAVA_WB if dialect == "java" else r"\b"


def escape(phrase: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in phrase)


def alternatives(entries: list[str]) -> str:
    parts = [e[3:] if e.startswith("re:") else escape(e) for e in entries]
    return "(?:" + "|".join(parts) + ")"


def any_of(entries: list[str]) -> str:
    """Case-insensitive substring match of any entry."""
    return "(?i)" + alternatives(entries)


ACK = any_of(fixed.ACK_PHRASES)
REJECTION = any_of(fixed.REJECTION_PHRASES)
REJECTION_CUE = any_of(fixed.REJECTION_CUE_PHRASES)
INVITATION = any_of(fixed.INVITATION_PHRASES)
SIGNAL = any_of(fixed.SIGNAL_PHRASES)
COMPENSATION = any_of(fixed.COMPENSATION_PHRASES)
JUNK_LINK = any_of(fixed.JUNK_LINK_PHRASES)
NON_COMPANY_HOST = any_of(fixed.NON_COMPANY_HOSTS)
OFFER_WORD = "(?i)offer"
HTTP_PREFIX = "(?i)^https?://"


def generic_sender(d: str) -> str:
    return "(?i)^" + alternatives(fixed.GENERIC_SENDER_WORDS) + wb(d)


def suffix_after_separator() -> str:
    seps = "".join(escape(s) if s != "-" else "\\-" for s in fixed.COMPANY_SUFFIX_SEPARATORS)
    return (
        "(?i)" + WS + "*[" + seps + "]" + WS + "*" + alternatives(fixed.COMPANY_SUFFIX_WORDS) + ".*\\z"
    )


def suffix_trailing() -> str:
    return "(?i)" + WS + "+" + alternatives(fixed.COMPANY_SUFFIX_WORDS) + "\\z"


# trailing run of characters that are neither word characters, ')' nor "'"
TRAILING_NON_WORD = r"[^A-Za-z0-9_)']+\z"

# tokens of a line (``functions.reading``): words, white space, runs of anything else
TOKEN = r"[A-Za-z0-9_]+|" + WS + "+|[^A-Za-z0-9_" + WS[1:] + "+"

# a name goes on as far as its characters do, whatever its length
NAME_HEAD = "^[A-Za-z0-9_" + "".join("\\" + ch if ch == "-" else ch for ch in fixed.NAME_MARKS) + "]*"


# where an "on behalf of" capture ends: a full stop followed by space, or , ; newline
BEHALF_CUT = r"\.\s|[,;\n]"


def role_not_company(d: str) -> str:
    return "(?i)^the" + wb(d) + "|" + wb(d) + alternatives(fixed.ROLE_NOT_COMPANY_WORDS) + "s?\\z"


ROLE_APPLY_PREFIX = "(?i)^" + escape(fixed.ROLE_NOT_ROLE_START)


def whole_terms(terms: list[str]) -> str:
    """Case-insensitive whole-word / whole-phrase match of any term. The
    boundary is consumed instead of looked around, so Java and RE2 agree."""
    edge = r"[^\p{L}\p{N}_]"
    return "(?i)(?:^|" + edge + ")" + alternatives(terms) + "(?:" + edge + "|\\z)"
