"""SQL pieces for the checks, made from the same tables of fixed values."""

from __future__ import annotations

import re

from ..functions import vocabulary as V

#: White space as the regular expressions of the engine have it.
BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def quote(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def clean(c: str) -> str:
    """White space collapsed; nothing left gives null."""
    return f"nullif(trim(regexp_replace({c}, '{BLANK}+', ' ', 'g')), '')"


def share(n: str, d: str) -> str:
    """A percentage with one decimal."""
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE round(({n}) * 100.0 / ({d}), 1) END"


def categories(s: str) -> str:
    """The categories of a lower-case reason; what the patterns look around for is masked first."""
    masks = {
        "water_content": (r"\bwater(\s*-?\s*soluble|\s+per\s+ml)", r"\bwater\b|\bmoisture\b"),
        "loss_on_drying": (None, r"loss\s+on\s+drying|\bl\.?o\.?d\.?\b(\s|$)"),
        "assay": (r"(water|moisture) content\b", r"\bassay\b|\bcontent\b|labell?ed (?:amount|claim)|\bpotency\b|\bstrength\b"),
    }
    cases = []
    for name, pattern in V.FAILURE_CATEGORIES.items():
        mask, pattern = masks.get(name, (None, pattern))
        text = f"regexp_replace({s}, {quote(mask)}, ' ', 'g')" if mask else s
        cases.append(f"CASE WHEN regexp_matches({text}, {quote(pattern)}) THEN '{name}' END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def mapping(table: dict[str, object]) -> str:
    """A map literal."""
    value = lambda v: quote(v) if isinstance(v, str) else repr(v)
    return "MAP {" + ", ".join(f"{quote(k)}: {value(v)}" for k, v in table.items()) + "}"


def states_named(s: str) -> str:
    """The distinct states a text names, in order."""
    names = "|".join(re.escape(x).replace(r"\ ", " ") for x in sorted(V.STATES, key=len, reverse=True))
    known = mapping({n.lower(): V.STATE_ALIASES.get(n.lower(), n) for n in V.STATES})
    short = ", ".join(f"CASE WHEN regexp_matches({s}, {quote('(?i)' + p)}) THEN {quote(n)} END" for n, p in V.STATE_ABBREVIATIONS.items())
    return f"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all({s}, {quote(f'(?i)\\b({names})\\b')}, 1), lambda x: ({known})[lower(x)]), list_filter([{short}], lambda x: x IS NOT NULL))))"


def state(c: str) -> str:
    """SELECT of value, state and flag for each distinct value of a column of nsq_records."""
    low, high = V.PIN_RANGE
    return f"""
WITH v AS (SELECT DISTINCT {c} AS value, {clean(c)} AS s FROM nsq_records),
n AS (SELECT value, s, coalesce({states_named('s')}, []) AS named,
        list_filter(regexp_extract_all(s, '\\d+'), lambda x: len(x) = 6 AND x::INT BETWEEN {low} AND {high})[-1] AS pin FROM v),
p AS (SELECT *, CASE WHEN pin[1:3] IN ({', '.join(map(quote, V.PIN_STALE))}) THEN NULL ELSE coalesce(({mapping(V.PIN3)})[pin[1:3]], ({mapping(V.PIN2)})[pin[1:2]]) END AS by_pin FROM n)
SELECT value,
  CASE WHEN s IS NULL OR regexp_matches(s, {quote(V.UNKNOWN_MAKER)}) THEN NULL WHEN len(named) = 1 THEN named[1] WHEN len(named) > 1 THEN NULL ELSE by_pin END AS state,
  CASE WHEN s IS NULL THEN 'state_not_derived:no_address' WHEN regexp_matches(s, {quote(V.UNKNOWN_MAKER)}) THEN 'state_not_derived:manufacturer_unknown' WHEN len(named) = 1 THEN NULL
       WHEN len(named) > 1 THEN 'state_ambiguous:' || array_to_string(named, '/') WHEN by_pin IS NOT NULL THEN 'state_derived_from_pin:' || pin WHEN pin IS NOT NULL THEN 'state_ambiguous_pin:' || pin[1:3]
       ELSE 'state_not_derived:no_match' END AS flag
FROM p
"""


def labs() -> str:
    """SELECT of lab, type, basis and records of all distinct laboratories."""
    cases = [f"WHEN lab = '' OR regexp_matches(lab, {quote(V.NOT_A_LAB)}) THEN ['unknown', 'not_a_lab_name']"]
    for rows, kind, why in ((V.STATE_RUN_LABS, "state", "state_run_regional_lab"), (V.CENTRAL_LABS, "central", "cdsco_laboratory")):
        cases += [f"WHEN regexp_matches(norm, {quote(rf'\b{town}\b')}) AND regexp_matches(norm, {quote('(?i)' + p)}) THEN ['{kind}', '{why}:{source}']" for _, p, town, source in rows]
    marker = f"regexp_extract(norm, {quote('(?i)' + V.STATE_LAB_MARKERS)}, 1)"
    cases += [
        f"WHEN regexp_matches(norm, {quote('(?i)' + V.LAB_OFFICE[0])}) THEN ['central', 'cdsco_office']",
        f"WHEN {marker} <> '' THEN ['state', 'state_marker:' || lower({marker})]",
        f"WHEN norm IN ({', '.join(quote(x.upper()) for x in [*V.STATES, 'NCT of Delhi'])}) THEN ['state', 'bare_state_name']",
    ]
    return f"""
WITH l AS (SELECT testing_lab AS lab, upper(trim(regexp_replace(testing_lab, '[^A-Za-z0-9&]+', ' ', 'g'))) AS norm, count(*) AS records FROM nsq_records WHERE testing_lab IS NOT NULL GROUP BY 1, 2),
c AS (SELECT lab, records, CASE {' '.join(cases)} ELSE ['unknown', 'unrecognised_lab'] END AS x FROM l)
SELECT lab, x[1] AS type, x[2] AS basis, records FROM c
"""


def check_flags() -> str:
    """The flags of a record's fields as a list."""
    need = [f"CASE WHEN coalesce({f}, '') = '' THEN 'missing_required:{f}' END" for f in V.REQUIRED_FIELDS]
    years = [f"CASE WHEN try_cast(nullif(regexp_extract({f}, '^(\\d{{4}})', 1), '') AS INT) NOT BETWEEN {V.YEARS[0]} AND {V.YEARS[1]} THEN 'date_implausible:{f}=' || {f} END" for f in ("mfg_date", "expiry_date")]
    late = "CASE WHEN len(mfg_date) >= 7 AND len(expiry_date) >= 7 AND expiry_date[1:7] < mfg_date[1:7] THEN 'expiry_before_mfg:' || mfg_date || '>' || expiry_date END"
    batch = f"CASE WHEN trim(batch_number, ' ') <> '' AND (len(trim(batch_number, ' ')) > {V.LONGEST_BATCH} OR NOT regexp_matches(trim(batch_number, ' '), '[A-Za-z0-9]')) THEN 'batch_number_implausible:' || trim(batch_number, ' ')[1:30] END"
    return f"list_filter([{', '.join([*need, late, *years, batch])}], lambda x: x IS NOT NULL)"


def confidence(flags: str) -> str:
    """1 less what each flag takes off, not under the floor."""
    table = mapping({k: round(v * 1000) for k, v in V.DEDUCTIONS.items()})
    off = f"coalesce(list_sum(list_transform({flags}, lambda f: coalesce(({table})[split_part(f, ':', 1)], {round(V.DEFAULT_DEDUCTION * 1000)}))), 0)"
    return f"greatest(1000 - {off}, {round(V.LEAST_CONFIDENCE * 1000)}) / 1000.0"


def stems(name: str, column: str) -> str:
    """All stems' words of a column, as rows of a union: class, stem, word and ``column``."""
    own = [f"SELECT {quote(kind)} AS class, {quote(stem)} AS stem, lower(unnest(regexp_extract_all({name}, {quote('(?i)' + p)}))) AS word, {column} FROM names" for p, kind, stem in V.STEMS]
    return " UNION ALL ".join(own)


def month(c: str) -> str:
    """A month's name and a year as YYYY-MM, else null."""
    names = mapping({m: f"{i:02d}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)})
    pattern = r"'^\s*([A-Za-z]{3,})[-/\s]+(\d{4})\s*$'"
    return f"CASE WHEN regexp_matches({c}, {pattern}) THEN regexp_extract({c}, {pattern}, 2) || '-' || ({names})[lower(regexp_extract({c}, {pattern}, 1)[1:3])] END"


def partial_date(c: str) -> str:
    """A date that may lack its day: the first form that it has."""
    names = mapping({m: f"{i:02d}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)})
    mm, day, short = r"'^(\d{1,2})[/-](\d{4})$'", r"'^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$'", r"'^([A-Za-z]{3,})''?\s*(\d{2})$'"
    part = lambda p, n: f"regexp_extract({c}, {p}, {n})"
    number = lambda p, n: f"try_cast({part(p, n)} AS INT)"
    return (
        f"coalesce({month(c)}, CASE WHEN regexp_matches({c}, {mm}) AND {number(mm, 1)} BETWEEN 1 AND 12 THEN {part(mm, 2)} || '-' || lpad({part(mm, 1)}, 2, '0') END, "
        f"CASE WHEN regexp_matches({c}, {day}) AND {number(day, 2)} BETWEEN 1 AND 12 AND {number(day, 1)} BETWEEN 1 AND 31 THEN {part(day, 3)} || '-' || lpad({part(day, 2)}, 2, '0') || '-' || lpad({part(day, 1)}, 2, '0') END, "
        f"CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}(?:-\\d{{2}})?') THEN {c}[1:10] END, CASE WHEN regexp_matches({c}, {short}) THEN '20' || {part(short, 2)} || '-' || ({names})[lower({part(short, 1)}[1:3])] END)"
    )
