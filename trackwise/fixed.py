"""Fixed values.

Everything in this module is a value that must stay exactly as written for the
results to agree with the behaviour being reproduced: phrase lists, status sets,
limits and formats. They are stated plainly, in their natural order. Regular
expressions are *built* from these lists by ``trackwise.functions.patterns``;
nothing else in the package hard-codes a phrase.

Entries of the phrase lists are matched case-insensitively as substrings. A few
entries need a tiny bit of pattern syntax (an optional character, an arbitrary
word); those entries are marked with a leading ``re:``.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: categories, statuses, limits
# ---------------------------------------------------------------------------

CATEGORIES = ["Invitation", "Applied", "Rejection", "Offer", "Other"]

# default step label per category when the scorer omits one
DEFAULT_STEP = {
    "Invitation": "Interview",
    "Applied": "Applied",
    "Rejection": "Rejected",
    "Offer": "Offer",
    "Other": "Update",
}

# statuses a user may set by hand
OVERRIDE_STATUSES = ["Applied", "Interviewing", "Offer", "Rejected", "Withdrawn", "Archived"]

# category shown for a manual status
MANUAL_CATEGORY = {"offer": "Offer", "interviewing": "Invitation", "applied": "Applied"}

# a position is finished when its category or status is one of these
TERMINAL = ["rejection", "offer", "rejected", "withdrawn", "archived"]

# statuses that close a segment (besides category Rejection); offer does not
CLOSING_STATUSES = ["rejected", "withdrawn", "archived"]

# role texts that mean "no role"
PLACEHOLDER_ROLES = [
    "unknown",
    "n/a",
    "na",
    "none",
    "not specified",
    "unspecified",
    "not specified in the email",
    "not mentioned",
    "—",
    "-",
]

STALE_DAYS = 14
OVERLAP_SECONDS = 600
DIGEST_WINDOW_MINUTES = 60
CONTAIN_MIN_LEN = 7
RETRYABLE_HTTP = [429, 503]
DISPLAY_TZ = "Asia/Jerusalem"
SELF_MARKER_HEADER = "x-trackwise-digest"
SELF_MARKER_VALUE = "yes"
NO_SUBJECT = "(no subject)"

# digest text pieces
DIGEST_UNKNOWN_COMPANY = "Unknown company"
DIGEST_NO_ROLE = "(role unspecified)"
DIGEST_SUBJECT_ONE = "Status digest: news from {company}"
DIGEST_SUBJECT_ONE_FALLBACK = "a company"
DIGEST_SUBJECT_MANY = "Status digest: {items} items from {companies} companies"
DIGEST_BODY_HEAD_ONE = "There is news about one company."
DIGEST_BODY_HEAD_MANY = "There is news about several companies."
DIGEST_BODY_TAIL = "The funnel has been updated."
DIGEST_COMPANY_BULLET = "■ "
DIGEST_ROLE_BULLET = "  • "
DIGEST_INTERVIEW_LINE = "    Interview scheduled for "
DIGEST_SUMMARY_INDENT = "    "

# calendar / outbound link formats
CALENDAR_BASE = "https://calendar.google.com/calendar/render?"
SEARCH_BASE = "https://www.google.com/search?q="
PEOPLE_SEARCH_BASE = "https://www.linkedin.com/search/results/people/?keywords="
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# ---------------------------------------------------------------------------
# FIXED VALUES: phrase lists for the rule classifier (English, then Hebrew)
# ---------------------------------------------------------------------------

# acknowledgement of an application
ACK_PHRASES = [
    "thank you for applying",
    "thanks for applying",
    "thank you for your interest",
    "thank you for your application",
    "re:we(?:'ve| have| ?)? ?(?:got it|received your (?:application|cv|resume))",
    "application received",
    "application has been received",
    "received your application",
    "we are reviewing your application",
    "under review",
    "תודה על הגשת",
    "תודה על פנייתך",
    "תודה על התעניינות",
    "תודה על הגשתך",
    "קיבלנו את מועמדות",
    "קיבלנו את פנייתך",
    "קיבלנו את קורות",
    "re:מועמדות[ךn]? התקבלה",
]

# a definite rejection
REJECTION_PHRASES = [
    "unfortunately",
    "we regret to inform",
    "we are sorry to inform",
    "regret to inform",
    "re:not (?:be )?(?:moving|proceeding|progressing|continuing) (?:forward|with)",
    "re:will not be (?:moving|proceeding|progressing|continuing)",
    "re:won'?t be (?:moving|proceeding|continuing)",
    "re:(?:decided|chosen) (?:not to (?:move|proceed|continue|advance|progress)|to (?:move|proceed) with other)",
    "other candidates",
    "move forward with other",
    "re:position (?:has been|was|is now) filled",
    "no longer available",
    "no longer under consideration",
    "re:not (?:to )?(?:be )?selected",
    "re:wish(?:ing)? you (?:all )?(?:the best|success) in your",
    "לצערנו",
    "לא נמשיך",
    "לא נתקדם",
    "לא נוכל להמשיך",
    "הוחלט שלא",
    "הוחלט לא",
    "לא נבחרת",
    "re:מאחל(?:ים)? לך הצלחה",
]

# weak rejection cues: an acknowledgement carrying one is not safe to shortcut
REJECTION_CUE_PHRASES = [
    "re:not to (?:continue|proceed|move|advance|progress)",
    "re:at this (?:stage|time|point)[,.]",
    "best of luck",
    "re:wish(?:ing)? you (?:all )?the best",
    "future opportunities",
    "future openings",
    "future roles",
    "better fit",
    "keep an eye on",
    "keep your cv",
    "keep you in mind",
    "לא להמשיך",
    "בשלב זה",
    "בהצלחה",
    "הזדמנויות עתידיות",
]

# strong, present-tense invitation language
INVITATION_PHRASES = [
    "re:please (?:schedule|book|pick|select|choose|confirm)",
    "re:book a (?:time|slot|call|meeting)",
    "what times work",
    "are you available",
    "your availability",
    "re:let'?s (?:set up|schedule|find a time)",
    "re:set up a (?:call|meeting|chat)",
    "re:schedule (?:a |an |your )?(?:call|interview|meeting|chat|time)",
    "re:invite you to (?:an? |the )?(?:[A-Za-z0-9_-]+ )?(?:interview|call|meeting|chat)",
    "re:invitation to (?:an? )?interview",
    "re:complete the (?:assignment|task|assessment|exercise)",
    "home assignment",
    "re:technical (?:assessment|test|exercise)",
    "calendly",
    "cal.com",
    "נשמח לתאם",
    "re:מוזמן(?:ת)? ל(?:ראיון|שיחה|פגישה)",
    "זימון לראיון",
    "re:לקבוע (?:שיחה|ראיון|פגישה)",
]

# broader interview / recruiter signal: decides whether undecided mail is worth scoring
SIGNAL_PHRASES = [
    "interview",
    "phone screen",
    "screening",
    "recruiter",
    "talent acquisition",
    "hiring manager",
    "next step",
    "move forward",
    "schedule",
    "availability",
    "set up a",
    "chat with",
    "speak with",
    "home assignment",
    "assessment",
    "offer",
    "ראיון",
    "זימון",
    "לתאם",
    "שיחה עם",
    "שיחה טלפונית",
    "מעוניינים לראיין",
    "הצעת עבודה",
    "הצעת שכר",
]

# vocabulary only a real job offer contains
COMPENSATION_PHRASES = [
    "compensation",
    "salary",
    "equity",
    "re:stock options?",
    "offer letter",
    "offer of employment",
    "employment agreement",
    "employment contract",
    "base pay",
    "annual base",
    "signing bonus",
    "sign-on bonus",
    "start date",
    "שכר",
    "תנאי העסקה",
    "חוזה העסקה",
    "הצעת שכר",
    "בונוס חתימה",
    "תאריך תחילה",
]

# sender display names that do not name a company (matched at the start, whole word)
GENERIC_SENDER_WORDS = [
    "re:no.?reply",
    "re:do.?not.?reply",
    "re:careers?",
    "re:recruit(?:ing|ment)?",
    "re:jobs?",
    "talent",
    "hiring",
    "re:notifications?",
    "hr",
    "hello",
    "info",
    "support",
    "team",
    "mailer",
    "mail",
    "admin",
    "apply",
    "application",
    "greenhouse",
    "lever",
    "workday",
    "comeet",
    "workable",
]

# recruiting suffix words stripped from company names
COMPANY_SUFFIX_WORDS = ["re:careers?", "re:recruit(?:ing|ment)?", "talent", "hr", "re:jobs?", "hiring", "team"]

# separators before a recruiting suffix ("Acme | Careers", "Acme - Jobs")
COMPANY_SUFFIX_SEPARATORS = ["|", "-", "–", "—", ":"]

# a captured "company" that is really a role
ROLE_NOT_COMPANY_WORDS = ["role", "position", "opening"]

# phrases before a company name in a subject, and in a body
COMPANY_LEADS = [
    "applying to",
    "applying with",
    "applying at",
    "applying for a position at",
    "application to",
    "application with",
    "application at",
    "application for a position at",
    "applied to",
    "applied with",
    "applied at",
    "applied for a position at",
]
COMPANY_ROLE_LEADS = ["position at", "position with", "role at", "role with"]
COMPANY_PLACE_LEAD = "at"
COMPANY_BEHALF_LEAD = "on behalf of"

# characters of a name besides ASCII letters, digits and "_"
NAME_MARKS = " .&'-"

# phrases before a role in a subject, label words before ":" or "-", and the word before a closing phrase
ROLE_LEADS = ["applying for", "apply for", "for the position of", "position of", "interview for"]
ROLE_LABELS = ["position", "role"]
ROLE_PHRASE_LEAD = "for"

# marks that a closing phrase does not hold
PHRASE_END_MARKS = ",.!|"

# words that end a role inside a subject
ROLE_STOP_WORDS = ["at", "@", "with", "position", "role", "opening", "opportunity", "req", "requisition"]

# a "role" that begins like this is the application itself
ROLE_NOT_ROLE_START = "apply"

# links never surfaced as a company site
JUNK_LINK_PHRASES = [
    "unsubscribe",
    "mailto:",
    "tel:",
    "/preferences",
    "/privacy",
    "/terms",
    "facebook.com",
    "twitter.com",
    "x.com",
    "instagram.com",
    "youtube.com",
    "linkedin.com/in",
    "linkedin.com/sharing",
    "t.me",
    "re:\\.(?:png|jpe?g|gif|svg|css|js)(?:[?#]|$)",
]

# trailing characters removed from a harvested link
LINK_TRAILING_CHARS = ")]\"'.,>"

# hosts that are recruiting systems, schedulers or search engines, not a company site
NON_COMPANY_HOSTS = [
    "greenhouse",
    "lever.co",
    "myworkday",
    "workday",
    "comeet",
    "workable",
    "ashbyhq",
    "smartrecruiters",
    "bamboohr",
    "teamtailor",
    "calendly",
    "cal.com",
    "google.com",
    "docs.google",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: default mailbox keyword filter (words and quoted phrases, OR-ed)
# ---------------------------------------------------------------------------

SEARCH_TERMS = [
    "interview",
    "call",
    "scheduling",
    "ראיון",
    "טלפוני",
    "שיחה",
    "לתאם",
    "זימון",
    "applying",
    "application",
    "applied",
    "candidate",
    "candidacy",
    "recruiting",
    "recruiter",
    "position",
    "role",
    "opportunity",
    "resume",
    "thank you for applying",
    "HR",
    "תפקיד",
    "משרה",
    "גיוס",
    "מועמד",
    "מועמדות",
    "מועמדותך",
    "קורות חיים",
    'קו"ח',
    "דרושים",
]
