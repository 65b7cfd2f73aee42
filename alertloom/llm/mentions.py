"""Firms and places read out of one free-typed cell (for problems 5 and 6)."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

#: Cells that name nobody and no place.
PLACEHOLDER = re.compile(r"(nil\b[\s,.]*)+|none|n\.?\s*a|n/a|not (mentioned|applicable|available|known|given|stated)|unknown|spurious|under investigation|nm|x+", re.I)
_MIDDLE = re.compile(r"\w(?:.*\w)?", re.S)
#: What stands before a firm's name, and legal forms.
LEAD = re.compile(r"^\s*(?:(?:m\s*/\s*s\b\.?|messrs\b\.?|(?:mfd|mfg|manufactured|marketed)\b\.?\s*by\b\s*:?)\s*)+", re.I)
LEGAL = {"pvt", "private", "ltd", "limited", "llp", "co", "company", "inc", "corp", "corporation", "and", "the", "india", "unit"}
#: What firms of this trade call their business.
TRADES = {
    "pharmaceuticals": ("pharmaceuticals", "pharmaceutical", "pharma", "pharm", "pharmacals"), "laboratories": ("laboratories", "laboratory", "labs", "lab"), "healthcare": ("healthcare",),
    "remedies": ("remedies", "remedy"), "formulations": ("formulations", "formulation", "formln", "formlns"), "biotech": ("biotech", "biotec", "biotechnology"), "lifesciences": ("lifesciences", "lifescience"),
    "industries": ("industries", "industry", "indus", "inds"), "drugs": ("drugs", "drug"), "chemicals": ("chemicals", "chemical", "chem"), "medicare": ("medicare",), "organics": ("organics",), "therapeutics": ("therapeutics",), "biologicals": ("biologicals",), "medicines": ("medicines",), "products": ("products",), "enterprises": ("enterprises",),
}
_TRADE = {w: t for t, ws in TRADES.items() for w in ws}
_LONG_TRADES = [w for w in _TRADE if len(w) >= 7]
#: Names of Indian states and the short forms in use.
STATES = re.compile(
    r"\b(?:himachal(?:\s*pr(?:adesh|\.)?)?|uttara?\s*khand|uttrakhand|uttaranchal|gujarat|gujrat|guj|maharas(?:h)?tra|punjab(?:\s+state)?|panjab|pb|haryana|hariyana|uttar\s*pr(?:adesh)?|t[ae]l[ae]n?gana|andhra\s*(?:pr(?:adesh)?)?|andhrapradesh|karnataka|tamil[\s-]*nadu|madhya\s*pr(?:adesh)?|w(?:est|\.)?[\s-]*bengal|sikkim|ker[ae]la|raja?sthan|odisha|orissa|assam|bihar|jharkhand|chh?attisgarh|new\s+delhi|delhi|goa|jammu\s*(?:and|&)\s*kashmir|j\s*(?:&|and)\s*k|puducherry|pondicherry|chandigarh|tripura|manipur|meghalaya|nagala?nd|mizoram|arunachal(?:\s*pr(?:adesh)?)?"
    r"|k'?taka|h\.?\s?p|u\.?\s?p|u\.?\s?k|t\.?\s?n|m\.?\s?p|m\.?\s?h|w\.?\s?b|a\.?\s?p|h\.?\s?r|india)\b\.?(?:[\s-]*state\b)?",
    re.I,
)
#: Words of those names, for misspelt ones.
_STATE_WORDS = ("himachal", "uttarakhand", "gujarat", "maharashtra", "punjab", "haryana", "telangana", "andhra", "pradesh", "karnataka", "bengal", "sikkim", "kerala", "rajasthan", "odisha", "orissa", "assam", "jharkhand", "chhattisgarh", "kashmir", "puducherry", "chandigarh", "tripura", "manipur", "meghalaya", "nagaland", "mizoram", "arunachal")
_AWAY = re.compile(
    r"\b(?:dl|lic)\b\.?\s*no\b\.?\s*[\w/]+"
    r"|\bn\.?\s?h\.?[\s-]*\d+\s*-?[a-z]?\b"
    r"|\b(?:phase|ph)\b[\s.\-]*(?:[ivx]+|\d+)\b"
    r"|\(?\bunit\b[\s.\-]*(?:no\b\.?\s*)?(?:[ivx]+|\d+)\b\)?"
    r"|\b(?:opp|opposite|near|nr|behind|beside|c/o)\b\.?\s*(?:water\s*tank|bus\s*stand|weigh\s*bridge|rice\s*mill|godown|[a-z]+\s+[a-z]+)"
    r"|\b(?:old\s+by\W?pass|[a-z]+)\b\.?\s*\b(?:road|rd|marg|street)\b\.?"
    r"|\b(?:industrial|indl|indus|ind|growth|export|exp)\b[\s.\-]*\b(?:area|estate|estt|est|centre|center|ctr|zone|park)\b\.?"
    r"|\bpharma[\s\-]*(?:park|pk)\b\.?|\b[ig]\.\s?[aec]\b\.?"
    r"|\b(?:distt?|district|dt|tehsil|teh)\b[\s.\-:]*[^\W\d_]+"
)
_PIN = re.compile(r"(?<![\d/&])(?<!\d[\s,-])(\d{3})\s?(\d{3})(?![\d/])")
_LABEL = re.compile(r"\b(?:plot|khasa?ra|kh|shed|survey|gat|p)\b[\s.]*(?:no\b)?[\s.\-:]*(?=[a-z]?[\s\-/]?\d)|#\s*|\bno\b[\s.\-:]*(?=[a-z]?[\s\-/]?\d)")
_ONE = r"(?:\b([a-z])[\s\-/]*)?\b(\d{1,5})(?:/(\d{1,4})\b|[\s\-/]*([a-z])\b(?!\.?\w))?"
_NUMBER = re.compile(_ONE + r"(?:\s*(?:-|–|&|\band\b|,|\bto\b|/)\s*(\d{1,5})\b(?!\s?\d))?")
_WORD = re.compile(r"[^\W\d_]+\.?")


class Mention(NamedTuple):
    """core: the words that make up the firm's own name; short: one of them is abbreviated; towns: words that may be the town."""

    placeholder: bool
    core: list[str]
    short: bool
    trades: list[str]
    plot: str | None
    pin: str | None
    towns: list[str]


def near(a: str, b: str, k: int) -> int:
    """Edits between two words, swaps of neighbours being one, within a band of k; k + 1 if there are more."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        lo, hi = max(1, i - k), min(m, i + k)
        new = [k + 1] * (m + 1)
        if lo == 1:
            new[0] = i
        for j in range(lo, hi + 1):
            x = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, before[j - 2] + 1)
            new[j] = x
        if min(new[max(0, lo - 1) : hi + 1]) > k:
            return k + 1
        before, row = row, new
    return min(row[m], k + 1)


def trade_of(word: str) -> str | None:
    """The trade a word stands for, misspelt or not."""
    if word in _TRADE:
        return _TRADE[word]
    if len(word) >= 6:
        for w in _LONG_TRADES:
            if word[0] == w[0] and near(word, w, 2) <= 2:
                return _TRADE[w]
    return None


def split_name(text: str) -> tuple[str, str]:
    """The firm's part of a cell and what follows: cut at the first comma, line break, spaced dash, label or number."""
    s = LEAD.sub("", text)
    s = re.sub(r"\[[^\]]*\]|\(\s*(?:unit|formulation\s+div)[^)]*\)", " ", s, flags=re.I)
    cut = re.search(r",|;|\n|\s[-–?]\s|\s[-–]|\bat\s*:|\bplot\b|#|\bkhasa?ra\b|\bkh\.|\bp\.\s?no|\b(?:dl|lic)\b\.?\s*no\b|\bno\b\.?\s*(?=[a-z]?\W?\d)|\bunit\b|\d", s, re.I)
    return (s[: cut.start()], s[cut.start() :]) if cut else (s, "")


def parse_name(name: str) -> tuple[list[str], bool, list[str]]:
    """The own words of a firm's name, whether any is shortened, and its trades."""
    s = unicodedata.normalize("NFKC", name).lower()
    s = re.sub(r"\bl\.?\s?l\.?\s?p\b\.?", " llp ", s)
    s = re.sub(r"\bhealth[\s\-]*car?e\b", "healthcare", s)
    s = re.sub(r"\blife[\s\-]*sciences?\b", "lifesciences", s)
    s = re.sub(r"\bbio[\s\-]*tech?\b", "biotech", s)
    s = re.sub(r"\(\s*p\s*\)|\bp\.?\s*(?=(?:ltd|limited)\b)", " ", s)
    words, trades, short = [], [], False
    for w in _WORD.findall(s):
        bare = w.rstrip(".")
        if bare in LEGAL:
            continue
        if t := trade_of(bare):
            trades.append(t)
            continue
        if len(bare) == 1 or w.endswith(".") and len(bare) <= 4:
            short = True
        words.append(bare)
    return words, short, sorted(set(trades))


def parse_place(text: str) -> tuple[str | None, str | None, list[str]]:
    """The plot, the pin code and the words that may be the town."""
    s = unicodedata.normalize("NFKC", text).lower().replace("?", " - ").replace("\n", " , ")
    s = re.sub(r"\s+", " ", s)
    s = _AWAY.sub(" , ", s)
    pins = list(_PIN.finditer(s))
    pin = None
    if pins:
        pin = pins[-1][1] + pins[-1][2]
        s = s[: pins[-1].start()] + " , " + s[pins[-1].end() :]
    s = STATES.sub(" , ", s)
    s = _LABEL.sub(" № ", s)
    plot = None
    at = s.find("№")
    hit = _NUMBER.search(s, at) if at >= 0 else None
    hit = hit or _NUMBER.search(s)
    if hit:
        before, n, sub, after, other = hit.groups()
        end = hit.end()
        n = n.lstrip("0") or "0"
        if other and not (int(n) < int(other) <= int(n) + 12):
            other, end = None, hit.start(5)
        plot = (before + "|" if before else "") + n + ("/" + sub if sub else "") + ("|" + after if after else "") + ("-" + other if other else "")
        s = s[: hit.start()] + " , " + s[end:]
    towns = [w for w in re.findall(r"[^\W\d_]+", s) if len(w) >= 4 and w not in LEGAL]
    if len(towns) > 1:
        towns = [w for w in towns if not any(w[0] == x[0] and near(w, x, 2) <= 2 for x in _STATE_WORDS)] or towns
    return plot, pin, towns


def parse(text: str, named: bool = True) -> Mention:
    """Read one cell; ``named``: a firm's name comes first."""
    middle = _MIDDLE.search(text)
    if not middle or len(middle[0]) < 40 and PLACEHOLDER.fullmatch(middle[0]):
        return Mention(True, [], False, [], None, None, [])
    core, short, trades, rest = [], False, [], text
    if named:
        name, rest = split_name(text)
        core, short, trades = parse_name(name)
    return Mention(False, core, short, trades, *parse_place(rest))
