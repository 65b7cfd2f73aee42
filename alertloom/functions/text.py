"""Scalar normalisers as Column expressions.

All but the first take text that has been through clean_text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as V
from .rules import every_match, first_match, in_order, let, lookup

_SPACE = r"(?U)\s+"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def _normal_form(c: Column, udf) -> Column:  # noqa: ANN001
    """Only what isn't ASCII goes through Python; the rest is passed as null."""
    other = ~c.rlike(r"^\p{ASCII}*$")
    return F.coalesce(udf(F.when(other, c)), c)


def clean_text(c: Column) -> Column:
    """Compatibility forms unified, white space collapsed; nothing left gives null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(_normal_form(c, _nfkc), _SPACE, " "), "^ | $", ""), F.lit(""))


def month_number(word: Column) -> Column:
    """The number of a month as two digits, by its first three letters; null if it is none."""
    return lookup({m: f"{i:02d}" for i, m in enumerate(V.MONTHS, 1)}, F.lower(F.substring(word, 1, 3)))


def _parts(c: Column, pattern: str, *groups: int) -> list[Column]:
    return [F.when(c.rlike(pattern), F.regexp_extract(c, pattern, g)) for g in groups]


def month(c: Column) -> Column:
    """A month's name and a year as YYYY-MM, else null."""
    name, year = _parts(c, r"^\s*([A-Za-z]{3,})[-/\s]+(\d{4})\s*$", 1, 2)
    return F.concat(year, F.lit("-"), month_number(name))


def partial_date(c: Column) -> Column:
    """struct(value, flag) of a date that may lack its day. An ISO date is taken by its first ten characters as it stands."""
    s = c
    mm, yy = _parts(s, r"^(\d{1,2})[/-](\d{4})$", 1, 2)
    d, m, y = _parts(s, r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", 1, 2, 3)
    name, short = _parts(s, r"^([A-Za-z]{3,})'?\s*(\d{2})$", 1, 2)
    ok = lambda x, most: x.cast("int").between(1, most)
    two = lambda x: F.lpad(x, 2, "0")
    value = F.coalesce(
        month(s),
        F.when(ok(mm, 12), F.concat(yy, F.lit("-"), two(mm))),
        F.when(ok(m, 12) & ok(d, 31), F.concat(y, F.lit("-"), two(m), F.lit("-"), two(d))),
        F.when(s.rlike(r"^\d{4}-\d{2}(?:-\d{2})?"), F.substring(s, 1, 10)),
        F.concat(F.lit("20"), short, F.lit("-"), month_number(name)),
    )
    earlier = F.coalesce(month(s), mm, d, F.when(s.rlike(r"^\d{4}-\d{2}"), s))
    def flagged(v: Column) -> Column:
        flag = F.when(v.isNotNull() & earlier.isNull() & name.isNotNull(), F.lit("date_two_digit_year_assumed_20xx")).when(s.isNotNull() & v.isNull(), F.concat(F.lit("date_unparsed:"), F.substring(s, 1, 40)))
        return F.struct(v.alias("value"), flag.alias("flag"))

    return let(value, flagged)


def section(c: Column) -> Column:
    """struct(value, flag) of the kind of laboratory that a reporting source names."""
    s = F.lower(F.coalesce(c, F.lit("")))
    central, state = s.contains("cdsco") | s.contains("central"), s.contains("state")
    value = F.when(central, "central_lab").when(state, "state_lab")
    flag = F.when(central | state, F.lit(None)).when(s == "", "alert_section_missing").otherwise(F.concat(F.lit("alert_section_unrecognised:"), F.substring(s, 1, 40)))
    return F.struct(value.alias("value"), flag.alias("flag"))


CATEGORY_ORDER = [*V.FAILURE_CATEGORIES, "other"]


def categories(c: Column) -> Column:
    """P5: struct(value, flag): all categories a failure reason names, or other."""
    s = F.lower(F.coalesce(c, F.lit("")))

    def flagged(found: Column) -> Column:
        flag = F.when(s == "", "failure_reason_empty").when(F.size(found) == 0, F.concat(F.lit("failure_category_unmapped:"), F.substring(s, 1, 60)))
        return F.struct(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other"))).alias("value"), flag.alias("flag"))

    return let(every_match(s, V.FAILURE_CATEGORIES), flagged)


def spurious_categories(found: Column) -> Column:
    """What is published as spurious is so, whatever else its reason names."""
    return in_order(F.array_union(F.array_remove(found, "other"), F.array(F.lit("spurious"))), CATEGORY_ORDER)


def state_name(c: Column) -> Column:
    """The present name of a state, its former one or the name itself."""
    return F.coalesce(lookup(V.STATE_ALIASES, F.lower(c)), c)


def pin_of(c: Column) -> Column:
    """The last six-digit number in the range of PIN codes."""
    runs = F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{6})(?!\d)"), F.lit(1))
    return F.try_element_at(F.filter(runs, lambda x: x.cast("int").between(*V.PIN_RANGE)), F.lit(-1))


def pins_of(c: Column) -> Column:
    """All six-digit numbers, distinct and in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\d{6})\b"), F.lit(1))))


def state_of_pin(pin: Column) -> Column:
    """struct(value, flag) of a PIN code's state; prefixes that lie in several states, or whose state has changed, give none."""
    good = F.coalesce(pin.rlike(r"^\d{6}$"), F.lit(False))
    inside = F.when(good, pin.cast("int").between(*V.PIN_RANGE)).otherwise(False)
    p3 = F.substring(pin, 1, 3)
    value = F.when(inside & ~p3.isin(V.PIN_STALE), F.coalesce(lookup(V.PIN3, p3), lookup(V.PIN2, F.substring(pin, 1, 2))))
    flag = F.when(inside, F.when(value.isNotNull(), F.concat(F.lit("state_derived_from_pin:"), pin)).otherwise(F.concat(F.lit("state_ambiguous_pin:"), p3)))
    return F.struct(value.alias("value"), flag.alias("flag"))


def states_named(s: Column) -> Column:
    """The distinct states that a text names in full or by an unambiguous abbreviation, in order."""
    names = "|".join(re.escape(x).replace(r"\ ", " ") for x in sorted(V.STATES, key=len, reverse=True))
    found = F.regexp_extract_all(s, F.lit(rf"(?i)\b({names})\b"), F.lit(1))
    full = F.transform(found, lambda x: lookup({n.lower(): V.STATE_ALIASES.get(n.lower(), n) for n in V.STATES}, F.lower(x)))
    short = every_match(s, {n: "(?i)" + p for n, p in V.STATE_ABBREVIATIONS.items()})
    return F.array_sort(F.array_distinct(F.concat(full, short)))


def state(address: Column, explicit: Column | None = None) -> Column:
    """struct(value, flag). A state given explicitly comes before one named in the address, that before the PIN code's; two named ones give none."""
    none = F.lit(None).cast("string")
    given = explicit if explicit is not None else none
    out = lambda value, flag: F.struct(value.alias("value"), flag.alias("flag"))

    def decide(x: Column) -> Column:
        named, by_pin = x["named"], x["by_pin"]
        cases = [
            (given.isNotNull(), out(state_name(given), none)),
            (address.isNull(), out(none, F.lit("state_not_derived:no_address"))),
            (address.rlike(V.UNKNOWN_MAKER), out(none, F.lit("state_not_derived:manufacturer_unknown"))),
            (F.size(named) == 1, out(named[0], none)),
            (F.size(named) > 1, out(none, F.concat(F.lit("state_ambiguous:"), F.array_join(named, "/")))),
            (by_pin["flag"].isNotNull(), by_pin),
        ]
        return first_match(cases, out(none, F.lit("state_not_derived:no_match")))

    return let(F.struct(states_named(address).alias("named"), let(pin_of(address), state_of_pin).alias("by_pin")), decide)


def lab_key(c: Column) -> Column:
    """Upper case, everything but letters, digits and & to blanks."""
    return F.upper(F.trim(F.regexp_replace(c, r"[^A-Za-z0-9&]+", " ")))


def lab(c: Column) -> Column:
    """P20: struct(type, canonical, basis) of a laboratory's name; the rules come in a fixed order and the first that holds decides."""
    none = F.lit(None).cast("string")
    out = lambda kind, name, basis: F.struct(F.lit(kind).alias("type"), name.alias("canonical"), basis.alias("basis"))

    def decide(x: Column) -> Column:
        norm, marker = x["norm"], x["marker"]
        cases = [(c.isNull() | (c == "") | c.rlike(V.NOT_A_LAB), out("unknown", none, F.lit("not_a_lab_name")))]
        for labs, kind, why in ((V.STATE_RUN_LABS, "state", "state_run_regional_lab"), (V.CENTRAL_LABS, "central", "cdsco_laboratory")):
            cases += [(norm.rlike(rf"\b{town}\b") & norm.rlike("(?i)" + pattern), out(kind, F.lit(name), F.lit(f"{why}:{source}"))) for name, pattern, town, source in labs]
        cases += [
            (norm.rlike("(?i)" + V.LAB_OFFICE[0]), out("central", F.lit(V.LAB_OFFICE[1]), F.lit("cdsco_office"))),
            (marker != "", out("state", none, F.concat(F.lit("state_marker:"), F.lower(marker)))),
            (norm.isin([n.upper() for n in [*V.STATES, "NCT of Delhi"]]), out("state", none, F.lit("bare_state_name"))),
        ]
        return first_match(cases, out("unknown", none, F.lit("unrecognised_lab")))

    marked = let(lab_key(c), lambda n: F.struct(n.alias("norm"), F.regexp_extract(n, "(?i)" + V.STATE_LAB_MARKERS, 1).alias("marker")))
    return let(marked, decide)


def lab_with_flag(c: Column, published: Column) -> Column:
    """P10: struct(type, canonical, flag): the laboratory's kind, with a flag where the published section says otherwise."""
    kind = F.regexp_extract(published, "^(central|state)_lab$", 1)

    def flagged(x: Column) -> Column:
        flag = F.when((x["type"] != "unknown") & (kind != "") & (kind != x["type"]), F.concat(F.lit("alert_section_disputed:published_"), kind, F.lit("_lab_but_"), x["basis"])).when(
            (x["type"] == "unknown") & (c != ""), F.concat(F.lit("lab_type_underived:"), F.substring(c, 1, 40))
        )
        return F.struct(x["type"].alias("type"), x["canonical"].alias("canonical"), flag.alias("flag"))

    return let(lab(c), flagged)


def drug_key(c: Column) -> Column:
    """A product's name for searching: no curly quotes, no bracket left open at the end, lower case, no marks around it."""
    s = F.regexp_replace(F.regexp_replace(c, "[‘’“”]", ""), r"\s*[\(\[]\s*$", "")
    return F.nullif(F.regexp_replace(F.lower(s), r"^[ .,\-]+|[ .,\-]+$", ""), F.lit(""))


def record_id(month_: Column, *fields: Column) -> Column:
    """A hash over the month and the fields that identify a tested sample, nulls being empty."""
    parts = [F.regexp_replace(F.trim(F.lower(F.coalesce(f, F.lit("")))), _SPACE, " ") for f in (month_, *fields)]
    return F.concat(F.lit("NSQ_"), F.coalesce(F.nullif(month_, F.lit("")), F.lit("unknown")), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def spurious_id(number: Column, hashed: Column) -> Column:
    """The published number if there is one, else the hash."""
    return F.concat(F.lit("SPU_"), F.coalesce(number, F.substring(hashed, 5, 1000)))


def disputed(reply: Column, remarks: Column) -> Column:
    """struct(value, flag): whether a firm disputes that a batch is its own."""
    hit = F.concat_ws(" ", reply, remarks).rlike(V.DISPUTE)
    flag = F.when(~hit & F.coalesce(reply, remarks).isNull(), "dispute_status_unknown:no_firm_reply_or_remarks")
    return F.struct(hit.cast("int").alias("value"), flag.alias("flag"))


def reason_with_replies(reason: Column, reply: Column, remarks: Column) -> Column:
    """The reason, the firm's reply and the remarks, one below the other; what is null is left out."""
    return F.nullif(F.concat_ws("\n", reason, F.concat(F.lit("[Firm's reply] "), reply), F.concat(F.lit("[Remarks] "), remarks)), F.lit(""))


def company_parts(c: Column) -> Column:
    """struct(name, address) of a company's cell, cut at the first comma, address word or number."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), V.MESSRS, "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, V.CERTIFICATE, " "), _SPACE, " "))
    words = "|".join(V.ADDRESS_WORDS)
    # the place of a cut counts from the second character on: a cell that begins with one is not cut there
    ends = [rf"(?i)^(..*?)(?=[\s,.]\(?(?:{words})\b)", r"^(..*?)(?=[\s,]\(?\d)", r"^([^,]+)(?=,)"]
    tidy = lambda x: F.regexp_replace(x, r"^[ ,.\-]+|[ ,.\-]+$", "")

    def cut(t: Column) -> Column:
        at = F.least(*[F.when(t.rlike(p), F.length(F.regexp_extract(t, p, 1))) for p in ends], F.length(t))
        return let(at, lambda n: F.struct(F.coalesce(F.nullif(tidy(F.substring(t, F.lit(1), n)), F.lit("")), tidy(t)).alias("name"), tidy(F.substring(t, n + 1, F.length(t))).alias("address")))

    return let(s, cut)


def company_key(name: Column) -> Column:
    """A company's name with words of the trade folded and legal forms dropped; single letters and India at the end go too."""
    s = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    for pattern, word in V.NAME_FOLDS:
        s = F.regexp_replace(s, pattern, word)
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: ~w.isin(V.LEGAL_WORDS) & (w != ""))
    return F.trim(F.regexp_replace(F.array_join(words, " "), r"(?:(?:^|\s)(?:.|india|indian))+$", ""))


def company_core(key: Column) -> Column:
    """Without words of the trade, or the whole if nothing else is left."""
    return F.coalesce(F.nullif(F.array_join(F.filter(F.split(key, " "), lambda w: ~w.isin(V.GENERIC_WORDS)), " "), F.lit("")), key)


def plain(c: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def no_company(c: Column) -> Column:
    """P25: whether a cell names no company at all."""
    return F.coalesce(c.rlike(V.NO_COMPANY), F.lit(False))


def pair_id(a: Column, b: Column) -> Column:
    """The same for a pair in either order."""
    both = F.concat(F.least(a, b).cast("binary"), F.unhex(F.lit("00")), F.greatest(a, b).cast("binary"))
    return F.substring(F.sha1(both), 1, 16)


def tier(score: Column) -> Column:
    """What becomes of a pair with this score."""
    return F.when(score > V.AUTO_ABOVE, "auto").when(score >= V.REVIEW_FROM, "review").otherwise("no_match")


def slug(c: Column, most: int = 60) -> Column:
    """Letters and digits joined by dashes."""
    s = F.regexp_replace(_normal_form(F.coalesce(c, F.lit("")), _nfkd), r"[^a-zA-Z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.lower(F.regexp_replace(s, "^-+|-+$", "")), 1, most), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def members_hash(members: Column, digits: int = 8) -> Column:
    """A hash that depends on a group's members only."""
    return F.substring(F.sha1(F.array_join(F.array_sort(members), "\n")), 1, digits)


def percent(n: Column, d: Column) -> Column:
    """A share in percent with one decimal; of nothing it is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.round(n * 100.0 / d, 1))


def stem_classes(name: Column) -> Column:
    """The classes whose stems a name has, by each word; words whose stem misleads have their own."""
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    found = strings()
    for pattern, kind, _ in V.STEMS:
        words = F.transform(F.regexp_extract_all(name, F.lit("(?iU)" + pattern), F.lit(0)), F.lower)
        own = F.flatten(F.transform(words, lambda w: first_match([(w == x, strings(*v)) for x, v in V.STEM_EXCEPTIONS.items()], strings(kind))))  # noqa: B023
        found = F.array_union(found, own)
    return F.when(name.isNull(), strings()).otherwise(in_order(found, V.STEM_CLASSES))


def directory_state(c: Column) -> Column:
    """A state as a postal directory writes it, in our spelling."""
    known = lookup({"JAMMU & KASHMIR": "Jammu and Kashmir", "ANDAMAN & NICOBAR ISLANDS": "Andaman and Nicobar Islands", "DADRA & NAGAR HAVELI": "Dadra and Nagar Haveli", "DAMAN & DIU": "Daman and Diu"}, c)
    return state_name(F.coalesce(known, F.initcap(c)))


def batch_key(c: Column) -> Column:
    """A batch number's letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def long_month(c: Column) -> Column:
    """2025-06 as June 2025, with a day before it; anything else as it stands."""
    names = "January February March April May June July August September October November December".split()
    year, m, d = (F.regexp_extract(c, r"^(\d{4})-(\d{2})(?:-(\d{2}))?$", g) for g in (1, 2, 3))
    name = lookup({f"{i:02d}": n for i, n in enumerate(names, 1)}, m)
    return F.when(name.isNull(), c).otherwise(F.concat(F.when(d != "", F.concat(F.regexp_replace(d, "^0", ""), F.lit(" "))).otherwise(""), name, F.lit(" "), year))


def short_month(c: Column) -> Column:
    """The same with three letters of the month."""
    return F.regexp_replace(long_month(c), r"^(\d+ )?([A-Za-z]{3})[A-Za-z]*", "$1$2")


def missing(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c == "")


def flag_texts(c: Column) -> Column:
    """What is shown for a record's flags, each text once."""
    return F.array_distinct(F.array_compact(F.transform(c, lambda f: lookup(V.FLAG_TEXTS, F.substring_index(f, ":", 1)))))


def confidence_label(c: Column) -> Column:
    """A confidence in words; unknown counts as medium."""
    return F.when(c >= 0.95, "high").when(c.isNull() | (c >= 0.8), "medium").otherwise("low")


def category_label(c: Column) -> Column:
    """A category in words."""
    words = F.replace(c, F.lit("_"), F.lit(" "))
    return F.when(c == "ph", "pH").otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 100)))


def pin_from_flags(c: Column) -> Column:
    """The PIN code that a state was derived from."""
    hit = F.try_element_at(F.filter(c, lambda f: F.startswith(f, F.lit("state_derived_from_pin:"))), F.lit(1))
    return F.split_part(hit, F.lit(":"), F.lit(2))


def reason_only(c: Column) -> Column:
    """A reason without the firm's reply and the remarks."""
    return F.regexp_replace(c, r"(?s)\n?\[(?:Firm's reply|Remarks)\] .*$", "")


def lab_code(c: Column) -> Column:
    """The kind of laboratory as a number."""
    return F.coalesce(lookup({"central": 0, "state": 1, "unknown": 2}, c), F.lit(2))


def blocking_keys(key: Column, core: Column) -> Column:
    """struct(kind, key): the first word of the core, its first four letters, and all words of the name in order."""
    first = F.coalesce(F.nullif(F.split_part(core, F.lit(" "), F.lit(1)), F.lit("")), F.lit("?"))
    keys = [("token", first), ("prefix", F.substring(first, 1, 4)), ("sorted", F.array_join(F.array_sort(F.split(key, " ")), " "))]
    return F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys])
