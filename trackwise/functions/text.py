"""Column expressions over text: normalisation, rule classification, field
extraction. All of them are built-in Spark SQL functions (JVM side, whole-stage
codegen); no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import patterns as P
from trackwise.functions import reading as R

J = "java"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: str | Column) -> Column:
    """null → '' (the engine keeps '' for missing strings)."""
    return F.coalesce(col(c), F.lit(""))


def jtrim(c: str | Column) -> Column:
    """Trim every kind of whitespace (Spark's trim without a list only removes ' '). No regular expression: this runs
    several times a row."""
    return F.btrim(blank(c), F.lit(P.WS_CHARS))


def norm(c: str | Column) -> Column:
    """FN-01: null → '', trim, lower."""
    return F.lower(jtrim(c))


def nonblank(c: Column) -> Column:
    return F.when(c != "", c)


def mail_text(subject: str | Column = "subject", body: str | Column = "body") -> Column:
    return F.concat_ws("\n", blank(subject), blank(body))


def keyword_filter(df, terms: list[str] | None = None, cols=("subject", "body")):
    """FLT-01: rows whose subject or body holds any term as a whole word/phrase."""
    pat = P.whole_terms(terms or fixed.SEARCH_TERMS)
    cond = None
    for c in cols:
        m = blank(c).rlike(pat)
        cond = m if cond is None else cond | m
    return df.filter(cond)


# ---------------------------------------------------------------------------
# FLT-04 / FN-09: rule classifier
# ---------------------------------------------------------------------------


def has_signal(subject="subject", body="body") -> Column:
    """FLT-04: strong invitation or weak interview signal present."""
    t = mail_text(subject, body)
    return t.rlike(P.INVITATION) | t.rlike(P.SIGNAL)


def rule_category(subject="subject", body="body") -> Column:
    """FN-09: 'Rejection', 'Applied' or null (undecided → scorer)."""
    t = mail_text(subject, body)
    return (
        F.when(t.rlike(P.REJECTION), F.lit("Rejection"))
        .when(t.rlike(P.ACK) & ~t.rlike(P.INVITATION) & ~t.rlike(P.REJECTION_CUE), F.lit("Applied"))
    )


# ---------------------------------------------------------------------------
# FN-07 / FN-05 / FN-06: company extraction
# ---------------------------------------------------------------------------


def clean_company(c: str | Column) -> Column:
    """FN-07: strip a recruiting suffix ('Acme Careers', 'Acme | Jobs')."""
    x = F.regexp_replace(blank(c), P.suffix_after_separator(), "")
    x = F.regexp_replace(x, P.suffix_trailing(), "")
    return jtrim(x)


def strip_trailing_nonword(c: Column) -> Column:
    return jtrim(F.regexp_replace(c, P.TRAILING_NON_WORD, ""))


def title_domain(domain: str | Column) -> Column:
    """FN-07: first DNS label, '-'/'_' → ' ', first letter upper-cased."""
    label = jtrim(F.translate(F.split(blank(domain), "\\.", -1).getItem(0), "-_", "  "))
    return F.when(label == "", F.lit("Unknown")).otherwise(
        F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 30))
    )


def company_from_subject(subject="subject") -> Column:
    """FN-05: the name behind the first kind of lead phrase that the subject holds; a name that is really a role
    gives ''."""
    raw = R.bind(
        R.tokens(blank(subject)),
        lambda t: F.coalesce(
            R.name_after(t, fixed.COMPANY_LEADS),
            R.name_after(t, fixed.COMPANY_ROLE_LEADS),
            R.name_after(t, [fixed.COMPANY_PLACE_LEAD], any_case=False),
        ),
    )
    return R.bind(
        strip_trailing_nonword(clean_company(raw)),
        lambda c: F.when(c.rlike(P.role_not_company(J)), F.lit("")).otherwise(c),
    )


def company_from_behalf(body="body") -> Column:
    name = F.split(R.names_behind(blank(body), fixed.COMPANY_BEHALF_LEAD), P.BEHALF_CUT, 2).getItem(0)
    return strip_trailing_nonword(clean_company(name))


def extract_company(subject="subject", body="body", sender_name="sender_name", sender_domain="sender_domain") -> Column:
    """FN-06: subject → 'on behalf of' → non-generic sender → titled domain →
    cleaned sender → 'Unknown'."""
    subj = company_from_subject(subject)
    behalf = company_from_behalf(body)
    cleaned = clean_company(sender_name)
    generic = blank(sender_name).rlike(P.generic_sender(J))
    dom = blank(sender_domain)
    return (
        F.when(subj != "", subj)
        .when(behalf != "", behalf)
        .when((cleaned != "") & ~generic, cleaned)
        .when(dom != "", title_domain(dom))
        .when(cleaned != "", cleaned)
        .otherwise(F.lit("Unknown"))
    )


# ---------------------------------------------------------------------------
# FN-08: role extraction
# ---------------------------------------------------------------------------


def extract_role(subject="subject") -> Column:
    """FN-08: what follows the first kind of lead that the subject holds, up to a stop word."""
    lead = R.bind(
        R.tokens(blank(subject)),
        lambda t: F.coalesce(
            R.rest_after(t, fixed.ROLE_LEADS),
            R.rest_after_label(t, fixed.ROLE_LABELS),
            R.phrase_after(t, fixed.ROLE_PHRASE_LEAD),
        ),
    )
    role = F.regexp_replace(R.until_stop(lead, fixed.ROLE_STOP_WORDS), P.TRAILING_NON_WORD, "")
    return R.bind(
        jtrim(F.regexp_replace(role, P.WS + "+", " ")),
        lambda r: F.when(~r.rlike(P.ROLE_APPLY_PREFIX) & (F.length(r) >= 2), r).otherwise(F.lit("Unknown")),
    )


# ---------------------------------------------------------------------------
# FN-10: entity key
# ---------------------------------------------------------------------------


def entity_key(company="company", domain="sender_domain") -> Column:
    slug = F.regexp_replace(F.lower(blank(company)), "[^a-z0-9]+", "")
    dom = jtrim(F.lower(blank(domain)))
    return (
        F.when((slug != "") & (slug != "unknown"), slug)
        .when(dom != "", dom)
        .otherwise(F.lit("unknown"))
    )


# ---------------------------------------------------------------------------
# FN-02: sender split
# ---------------------------------------------------------------------------


def sender_address(from_col="from_header") -> Column:
    f = blank(from_col)
    bracket = F.regexp_extract(f, "<([^>]+)>", 1)
    bare = F.regexp_extract(f, "([^\\s<>]+@[^\\s<>]+)", 1)
    return jtrim(F.when(f.rlike("<([^>]+)>"), bracket).otherwise(bare))


def sender_domain(from_col="from_header") -> Column:
    email = sender_address(from_col)
    return F.when(
        F.instr(email, "@") > 0, jtrim(F.lower(F.split(email, "@", -1).getItem(1)))
    ).otherwise(F.lit(""))


def sender_name(from_col="from_header") -> Column:
    f = blank(from_col)
    email = sender_address(from_col)
    no_addr = jtrim(F.regexp_replace(f, "^([^<]*)<[^>]*>", "$1"))
    name = jtrim(F.regexp_replace(no_addr, '^"|"\\z', ""))
    return F.when((name == "") & (email != ""), F.split(email, "@", -1).getItem(0)).otherwise(name)


# ---------------------------------------------------------------------------
# FLT-05..08, FLT-13: predicates over tracker/position values
# ---------------------------------------------------------------------------


def is_terminal(category="category", status="status") -> Column:
    return norm(category).isin(*fixed.TERMINAL) | norm(status).isin(*fixed.TERMINAL)


def is_boundary(category="category", status="status") -> Column:
    return (norm(category) == "rejection") | norm(status).isin(*fixed.CLOSING_STATUSES)


def is_manual(status="status", step="step") -> Column:
    st = norm(status)
    return (blank(status) != "") & (st != norm(step)) & st.isin(*[s.lower() for s in fixed.OVERRIDE_STATUSES])


def is_real_role(role="role") -> Column:
    r = norm(role)
    return (r != "") & ~r.isin(*fixed.PLACEHOLDER_ROLES)


def is_known_company(name="company") -> Column:
    n = norm(name)
    return (n != "") & (n != "unknown")


def role_tokens(role="role") -> Column:
    """FN-17: distinct [a-z0-9] runs of the normalised role."""
    return F.array_distinct(F.filter(F.split(norm(role), "[^a-z0-9]+", -1), lambda x: x != ""))
