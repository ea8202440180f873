"""DuckDB (RE2) SQL fragments: the independent oracle's version of the column
functions in ``trackwise.functions``. Patterns come from the same fixed lists."""

from __future__ import annotations

from trackwise import fixed
from trackwise.functions import patterns as P

D = "re2"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def blank(x: str) -> str:
    return f"coalesce({x}, '')"


def jtrim(x: str) -> str:
    return f"regexp_replace({blank(x)}, {q('^' + P.WS + '+|' + P.WS + '+' + chr(92) + 'z')}, '', 'g')"


def norm(x: str) -> str:
    return f"lower({jtrim(x)})"


def rlike(x: str, pat: str) -> str:
    return f"regexp_matches({x}, {q(pat)})"


def extract(x: str, pat: str, g: int = 1) -> str:
    return f"regexp_extract({x}, {q(pat)}, {g})"


def mail_text(subject: str = "subject", body: str = "body") -> str:
    return f"({blank(subject)} || chr(10) || {blank(body)})"


def has_signal(subject="subject", body="body") -> str:
    t = mail_text(subject, body)
    return f"({rlike(t, P.INVITATION)} OR {rlike(t, P.SIGNAL)})"


def rule_category(subject="subject", body="body") -> str:
    t = mail_text(subject, body)
    return (
        f"(CASE WHEN {rlike(t, P.REJECTION)} THEN 'Rejection' "
        f"WHEN {rlike(t, P.ACK)} AND NOT {rlike(t, P.INVITATION)} AND NOT {rlike(t, P.REJECTION_CUE)} THEN 'Applied' END)"
    )


def clean_company(x: str) -> str:
    y = f"regexp_replace({blank(x)}, {q(P.suffix_after_separator())}, '')"
    y = f"regexp_replace({y}, {q(P.suffix_trailing())}, '')"
    return jtrim(y)


def strip_trailing_nonword(x: str) -> str:
    return jtrim(f"regexp_replace({x}, {q(P.TRAILING_NON_WORD)}, '')")


def title_domain(x: str) -> str:
    label = jtrim(f"translate(split_part({blank(x)}, '.', 1), '-_', '  ')")
    return f"(CASE WHEN {label} = '' THEN 'Unknown' ELSE upper(substr({label}, 1, 1)) || substr({label}, 2) END)"


# ---- reading by tokens (``functions.reading``), as DuckDB list functions --------------------------------------------


def bind(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(P.TOKEN)})"


def rest(t: str, j: str) -> str:
    return f"array_to_string({t}[{j}:], '')"


def led(t: str, j: str, phrases: list[str], any_case: bool = True) -> str:
    """The two tokens a word before ``j``, joined, end in a phrase's words and white space."""
    out = []
    for p in phrases:
        n = 2 * len(p.split())
        before = f"regexp_replace(array_to_string({t}[{j} - {n}:{j} - 1], ''), {q(P.WS + '+')}, ' ', 'g')"
        out.append(f"({j} > {n} AND {'lower(' + before + ')' if any_case else before} = {q(p + ' ')})")
    return "(" + " OR ".join(out) + ")"


def first(t: str, where: str, text: str, proper: str) -> str:
    """The leftmost ``text`` at a place ``j`` with ``where``, of those that are ``proper`` (as ``x``)."""
    places = f"list_filter(range(1, len({t}) + 1), lambda j: {where})"
    return f"list_filter(list_transform({places}, lambda j: {text}), lambda x: {proper})[1]"


def name_after(t: str, phrases: list[str], any_case: bool = True) -> str:
    head = "^[A-Za-z0-9]." if any_case else "^[A-Z]."
    return first(t, led(t, "j", phrases, any_case), f"regexp_extract({rest(t, 'j')}, {q(P.NAME_HEAD)})", rlike("x", head))


def without_article(t: str, any_case: bool) -> str:
    word = f"lower({t}[j])" if any_case else f"{t}[j]"
    return f"CASE WHEN {word} = 'the' AND len({t}) >= j + 2 AND {rlike(t + '[j + 1]', P.WS)} THEN {rest(t, 'j + 2')} ELSE {rest(t, 'j')} END"


def company_from_subject(s="subject") -> str:
    names = ", ".join(
        [
            name_after("t", fixed.COMPANY_LEADS),
            name_after("t", fixed.COMPANY_ROLE_LEADS),
            name_after("t", [fixed.COMPANY_PLACE_LEAD], any_case=False),
        ]
    )
    raw = bind(tokens(blank(s)), "t", f"coalesce({names})")
    return bind(strip_trailing_nonword(clean_company(raw)), "c", f"CASE WHEN {rlike('c', P.role_not_company(D))} THEN '' ELSE c END")


def company_from_behalf(b="body") -> str:
    parts = f"regexp_split_to_array({blank(b)}, {q('(?i)' + P.escape(fixed.COMPANY_BEHALF_LEAD))})[2:]"
    lead = "^" + P.WS + "+"
    name = f"CASE WHEN {rlike('p', lead)} THEN regexp_extract(regexp_replace(p, {q(lead)}, ''), {q(P.NAME_HEAD)}) END"
    name = f"list_filter(list_transform({parts}, lambda p: {name}), lambda n: {rlike('n', '^[A-Za-z].')})[1]"
    return strip_trailing_nonword(clean_company(f"regexp_split_to_array({name}, {q(P.BEHALF_CUT)})[1]"))


def extract_company(subject="subject", body="body", sender_name="sender_name", sender_domain="sender_domain") -> str:
    subj = company_from_subject(subject)
    beh = company_from_behalf(body)
    cleaned = clean_company(sender_name)
    generic = rlike(blank(sender_name), P.generic_sender(D))
    dom = blank(sender_domain)
    return (
        f"(CASE WHEN {subj} <> '' THEN {subj} WHEN {beh} <> '' THEN {beh} "
        f"WHEN {cleaned} <> '' AND NOT {generic} THEN {cleaned} "
        f"WHEN {dom} <> '' THEN {title_domain(dom)} WHEN {cleaned} <> '' THEN {cleaned} ELSE 'Unknown' END)"
    )


def until_stop(x: str, stops: list[str]) -> str:
    words = [w for w in stops if w != "@"]
    spaced = f"coalesce(k > 1 AND {rlike('u[k - 1]', P.WS + chr(92) + 'z')}, false)"
    at = f"u[k] = '@' AND k > 1 AND ({spaced} OR {rlike('u[k - 1]', '[A-Za-z]' + chr(92) + 'z')}) AND {rlike('u[k + 1]', '^[A-Za-z0-9_]')}"
    kept = f"CASE WHEN lower(u[k]) IN {qlist(words)} AND {spaced} THEN '' WHEN {at} THEN ''"
    for w in words:
        stem = f"substr(u[k], 1, greatest(length(u[k]) - {len(w)}, 0))"
        kept += f" WHEN ends_with(lower(u[k]), {q(w)}) AND {rlike(stem, '[A-Za-z]' + chr(92) + 'z')} THEN {stem}"
    ends = f"list_transform(range(1, len(u) + 1), lambda k: {kept} END)"
    k = "list_filter(range(1, len(e) + 1), lambda m: e[m] IS NOT NULL)[1]"
    cut = f"CASE WHEN {k} IS NULL THEN array_to_string(u, '') ELSE array_to_string(u[:{k} - 1], '') || e[{k}] END"
    return bind(tokens(x), "u", bind(ends, "e", cut))


def extract_role(s="subject") -> str:
    lead = "^" + P.WS + "+"
    behind = f"regexp_replace({rest('t', 'j + 1')}, {q(lead)}, '')"
    value = f"regexp_replace(substr({behind}, 2), {q(lead)}, '')"
    marks = " AND ".join(f"NOT contains(x, {q(m)})" for m in fixed.PHRASE_END_MARKS)
    kinds = ", ".join(
        [
            first("t", led("t", "j", fixed.ROLE_LEADS), without_article("t", True), "x <> ''"),
            first("t", f"lower(t[j]) IN {qlist(fixed.ROLE_LABELS)} AND substr({behind}, 1, 1) IN (':', '-')", value, "x <> ''"),
            first("t", led("t", "j", [fixed.ROLE_PHRASE_LEAD], False), without_article("t", False), f"{rlike('x', '^[A-Z]')} AND {marks}"),
        ]
    )
    lead_text = bind(tokens(blank(s)), "t", f"coalesce({kinds})")
    role = f"regexp_replace({until_stop(lead_text, fixed.ROLE_STOP_WORDS)}, {q(P.TRAILING_NON_WORD)}, '')"
    role = jtrim(f"regexp_replace({role}, {q(P.WS + '+')}, ' ', 'g')")
    return bind(role, "r", f"CASE WHEN NOT {rlike('r', P.ROLE_APPLY_PREFIX)} AND length(r) >= 2 THEN r ELSE 'Unknown' END")


def entity_key(company="company", domain="sender_domain") -> str:
    slug = f"regexp_replace(lower({blank(company)}), '[^a-z0-9]+', '', 'g')"
    dom = jtrim(f"lower({blank(domain)})")
    return f"(CASE WHEN {slug} <> '' AND {slug} <> 'unknown' THEN {slug} WHEN {dom} <> '' THEN {dom} ELSE 'unknown' END)"


def sender_address(f="from_header") -> str:
    f = blank(f)
    return jtrim(
        f"(CASE WHEN {rlike(f, '<([^>]+)>')} THEN {extract(f, '<([^>]+)>')} ELSE {extract(f, '([^\\s<>]+@[^\\s<>]+)')} END)"
    )


def sender_domain(f="from_header") -> str:
    e = sender_address(f)
    return f"(CASE WHEN strpos({e}, '@') > 0 THEN {jtrim(f'lower(split_part({e}, {q(chr(64))}, 2))')} ELSE '' END)"


def sender_name(f="from_header") -> str:
    fb = blank(f)
    e = sender_address(f)
    no_addr = jtrim(f"regexp_replace({fb}, {q('^([^<]*)<[^>]*>')}, {q(chr(92) + '1')})")
    name = jtrim(f"regexp_replace({no_addr}, {q(chr(94) + chr(34) + '|' + chr(34) + chr(92) + 'z')}, '', 'g')")
    return f"(CASE WHEN {name} = '' AND {e} <> '' THEN split_part({e}, '@', 1) ELSE {name} END)"


def is_terminal(category="category", status="status") -> str:
    t = qlist(fixed.TERMINAL)
    return f"({norm(category)} IN {t} OR {norm(status)} IN {t})"


def is_boundary(category="category", status="status") -> str:
    return f"({norm(category)} = 'rejection' OR {norm(status)} IN {qlist(fixed.CLOSING_STATUSES)})"


def is_manual(status="status", step="step") -> str:
    st = norm(status)
    return f"({blank(status)} <> '' AND {st} <> {norm(step)} AND {st} IN {qlist([s.lower() for s in fixed.OVERRIDE_STATUSES])})"


def is_real_role(role="role") -> str:
    r = norm(role)
    return f"({r} <> '' AND {r} NOT IN {qlist(fixed.PLACEHOLDER_ROLES)})"


def is_known_company(name="company") -> str:
    n = norm(name)
    return f"({n} <> '' AND {n} <> 'unknown')"


def role_token_count(role="role") -> str:
    return f"len(list_distinct(list_filter(regexp_split_to_array({norm(role)}, '[^a-z0-9]+'), lambda x: x <> '')))"


WALL_RE = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})"


def wall_clock(x: str) -> str:
    s = jtrim(x)
    g = [f"cast({extract(s, WALL_RE, i)} as integer)" for i in range(1, 6)]
    return (
        f"(CASE WHEN {rlike(s, WALL_RE)} THEN "
        f"(make_date({g[0]}, 1, 1) + to_months({g[1]} - 1))::timestamp + to_days({g[2]} - 1) + to_hours({g[3]}) + to_minutes({g[4]}) END)"
    )
