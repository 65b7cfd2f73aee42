"""Schemas that drift between files: edit scripts between nested schemas, one consistent table (problem 1).

A file's schema is a tree: the root's children are the fields of its rows,
objects and arrays have children of their own. The script between two files is
the cheapest one of adding, deleting, renaming and moving nodes. Nodes with the
same path stay; the rest are matched by minimum-cost assignment, where
renaming costs what their names, types and contents differ by, moving a bit
more, and neither ever more than deleting and adding. The scripts of a feed,
one after the other, give each path of each file its first name: the
projection that is applied to that file.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise

#: Content features are counted in so many bins, like a count-min sketch of one row: a summary's size doesn't grow with the file.
BINS = 1021
#: A renamed field is at least so much like the old one.
LEAST_LIKENESS = 0.37
#: Taking a node to another parent costs so much besides what its likeness lacks.
MOVE_COST = 0.25
#: Between the names of a path: no dot, which a field's name may have itself.
SEP = "\x1f"
#: Objects within more objects than this are taken whole.
DEEPEST = 40
#: More distinct columns than this are no schema but data in the wrong place.
MOST_COLUMNS = 2000
#: Summaries of a feed that are kept parsed at once.
RECENT = 150
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def rows_of(body: str | None) -> list[dict]:
    """The row objects of an envelope; the payload may itself be a JSON text. Unreadable bodies have no rows."""
    try:
        v = json.loads(body) if body else None
        for _ in range(3):
            v = json.loads(v) if isinstance(v, str) else v
        p = v.get("payload") if isinstance(v, dict) else None
        for _ in range(3):
            p = json.loads(p) if isinstance(p, str) else p
        rows = p.get("aaData") if isinstance(p, dict) else None
    except (ValueError, AttributeError, RecursionError):
        return []
    rows = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
    return _sound(rows) if rows and _SURROGATE.search(body) else rows


_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _sound(v):  # noqa: ANN001, ANN202
    """The same value, with halves of surrogate pairs that stand alone replaced: no column can hold them."""
    if isinstance(v, str):
        return v.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(v, dict):
        return {_sound(k): _sound(x) for k, x in v.items()}
    return [_sound(x) for x in v] if isinstance(v, list) else v


#: Letters and digits by class, for the shape of a value.
_CLASSES = {c: "9" for c in range(48, 58)} | {c: "A" for c in range(65, 91)} | {c: "a" for c in range(97, 123)}
_RUNS = re.compile(r"([9aA])\1+")
_WORDS = re.compile(r"[^\W\d_]{3,}")


@lru_cache(1 << 16)
def _bin(s: str) -> str:
    return str(zlib.crc32(s.encode("utf-8", "surrogatepass")) % BINS)


def _binned(features: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for f, n in Counter(features).items():
        at = _bin(f)
        out[at] = out.get(at, 0) + n
    return out


_KINDS = {str: "string", bool: "boolean", int: "integer", float: "decimal", list: "array", dict: "object"}


def profile(values: list, depth: int = 1) -> dict:
    """A field's node: type counts (t), values (n), features of its scalars, taken all at once: words (w), shapes (s), how many (k), lengths (l), magnitudes (m); and its children (c)."""
    kinds = Counter(map(type, values))
    kinds.pop(type(None), None)
    inner: dict[str, list] = {}
    scalars = [v for v in values if v is not None]
    if kinds.keys() & {list, dict}:
        flat = [x for v in scalars for x in (v if isinstance(v, list) else [v])]
        for x in flat:
            if isinstance(x, dict):
                for k, y in x.items():
                    inner.setdefault(k, []).append(y)
        scalars = [x for x in flat if x is not None and not isinstance(x, (dict, list))]
    texts = [x if isinstance(x, str) else str(x) for x in scalars]
    numbers = [x for x in scalars if isinstance(x, (int, float)) and math.isfinite(x)] if kinds.keys() - {str} else []
    lines = "\n".join(texts).replace("\r", " ") if not any("\n" in x for x in texts) else "\n".join(x.replace("\n", " ").replace("\r", " ") for x in texts)
    coarse = lines.translate(_CLASSES)
    shapes = _RUNS.sub(r"\1", coarse).split("\n") if texts else []
    words = _WORDS.findall(lines.lower())
    # a value without any word is known by its shape
    words += ["#" + x for x, c, t in zip(shapes, coarse.split("\n"), texts) if not ("aaa" in c or "Aaa" in c or "AAA" in c or _WORDS.search(t.lower()))]
    return {
        "t": {_KINDS[k]: n for k, n in kinds.items()}, "n": sum(kinds.values()), "w": _binned(words), "s": _binned(shapes), "k": len(texts),
        "l": float(sum(map(len, texts))), "m": sum(math.log10(1 + abs(x)) for x in numbers), "c": {k: profile(v, depth + 1) for k, v in inner.items()} if depth < DEEPEST else {},
    }


def tree(rows: list[dict]) -> dict:
    """The schema tree of a file's rows. A key without any value but null is a field without a type."""
    fields: dict[str, list] = {}
    for r in rows:
        for k, v in r.items():
            fields.setdefault(k, []).append(v)
    return {k: profile(v) for k, v in fields.items()}


def _overlap(a: dict, na: int, b: dict, nb: int) -> float:
    keys = a.keys() | b.keys()
    least = sum(min(a.get(k, 0) / na, b.get(k, 0) / nb) for k in keys)
    most = sum(max(a.get(k, 0) / na, b.get(k, 0) / nb) for k in keys)
    return least / most if most else 0.0


def _cover(old: dict, new: dict, n: int) -> float:
    """The share of the new field's features that the old one has had."""
    total = sum(new.values())
    return sum(v for k, v in new.items() if k in old) / total if total and n else 0.0


def type_of(node: dict) -> str | None:
    """A field's type in a file: the usual one of its values; whole numbers among decimals are decimals."""
    t = node["t"]
    if not t:
        return None
    if set(t) == {"integer", "decimal"}:
        return "decimal"
    return max(sorted(t), key=lambda k: t[k])


def _words(name: str) -> list[str]:
    return [w for w in re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w not in ("str", "dt", "num", "lst")]


def name_likeness(a: str, b: str) -> float:
    """Words that two field names share, abbreviated or not."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    short = lambda s, t: s == t or len(s) >= 2 and s[0] == t[0] and re.match(".*".join(map(re.escape, s)), t) is not None
    hits = sum(any(short(s, t) or short(t, s) for t in y) for s in x), sum(any(short(s, t) or short(t, s) for t in x) for s in y)
    return hits[0] / len(x) * 0.5 + hits[1] / len(y) * 0.5


def content_likeness(a: dict, b: dict) -> float:
    """How much the contents of two fields look like one another's continuation."""
    if not a["k"] or not b["k"]:
        if a["c"] and b["c"]:
            return len(a["c"].keys() & b["c"].keys()) / len(a["c"].keys() | b["c"].keys())
        return 0.0
    numeric = [bool({"integer", "decimal"} & set(x["t"])) for x in (a, b)]
    if all(numeric):
        # numbers of one magnitude may still count different things: only what is very close goes on
        close = max(0.0, 1 - 0.7 * abs(a["m"] / a["k"] - b["m"] / b["k"]))
        return close if close >= 0.8 else close / 2
    if any(numeric):
        return 0.0
    words = max(_overlap(a["w"], a["k"], b["w"], b["k"]), _cover(a["w"], b["w"], b["k"]))
    shapes = max(_overlap(a["s"], a["k"], b["s"], b["k"]), _cover(a["s"], b["s"], b["k"]))
    length = 1 - min(1.0, abs(math.log((1 + a["l"] / a["k"]) / (1 + b["l"] / b["k"]))))
    return (0.65 * words + 0.35 * max(words, shapes)) * (0.5 + 0.5 * length)


def likeness(name: str, a: dict, other: str, b: dict) -> float:
    """Of an old and a new field, from 0 to 1. Fields without any value are alike by name only."""
    by_name = name_likeness(name, other)
    if not a["t"] or not b["t"]:
        return by_name
    content = content_likeness(a, b)
    kinds = set(a["t"]), set(b["t"])
    if not kinds[0] & kinds[1] and not any(x >= kinds[0] | kinds[1] for x in ({"array", "string"}, {"integer", "decimal"})):
        content *= 0.8
    return content * 0.7 + by_name * 0.3


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest assignment; there are at least as many columns as rows."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, p, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = [math.inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if p[j]:
            out[p[j] - 1] = j - 1
    return out


def _nodes(fields: dict, at: str = "") -> dict[str, dict]:
    """Every node of some subtrees by its path, parents first."""
    out = {}
    for k in sorted(fields):
        out[at + k] = fields[k]
        out |= _nodes(fields[k]["c"], at + k + SEP)
    return out


def _parent(path: str) -> str:
    return path.rpartition(SEP)[0]


def _leaf(path: str) -> str:
    return path.rpartition(SEP)[2]


def edit_script(old: dict, new: dict, back: dict[str, tuple[set[str], dict]] | None = None) -> list[tuple[str, str, str]]:
    """(change, path, old path): the cheapest script from one schema tree to another.

    Nodes with the same name under the same parents stay. All other nodes, of
    any depth, are matched by one minimum-cost assignment: adding and deleting
    a node cost 1 each, renaming one what its likeness lacks, and taking it to
    another parent MOVE_COST more. What goes or comes with its parent isn't
    reported again.
    ``back`` has the earlier content of names that were gone for a while, with
    the old names that would be the same field: a name that is more like its own
    past than like what goes is no new name for that.
    """
    gone: dict[str, dict] = {}
    come: dict[str, dict] = {}

    def part(a: dict, b: dict, at: str) -> None:
        gone.update(_nodes({k: a[k] for k in a.keys() - b.keys()}, at))
        come.update(_nodes({k: b[k] for k in b.keys() - a.keys()}, at))
        for k in sorted(a.keys() & b.keys()):
            if a[k]["c"] or b[k]["c"]:
                part(a[k]["c"], b[k]["c"], at + k + SEP)

    part(old, new, "")
    match: dict[str, str] = {}
    if gone and come:
        left, right = list(gone), list(come)
        price = []
        for g in left:
            row = []
            for c in right:
                x = likeness(_leaf(g), gone[g], _leaf(c), come[c])
                same, own = (back or {}).get(c, (None, None))
                if own is not None and g not in same and content_likeness(own, come[c]) >= content_likeness(gone[g], come[c]):
                    x = 0.0
                u, v = _parent(g), _parent(c)
                x -= MOVE_COST * (u != v and not (u in gone and v in come))
                row.append(1 - x if x >= LEAST_LIKENESS else 2.0)
            price.append(row + [1.0 if i == len(price) else 2.0 for i in range(len(left))])
        match = {left[i]: right[j] for i, j in enumerate(assign(price)) if j < len(right) and price[i][j] < 2.0}
    found = set(match.values())
    script = []
    for g, c in match.items():
        u, v = _parent(g), _parent(c)
        if match.get(u, u) != v:
            script.append(("moved", c, g))
        elif _leaf(g) != _leaf(c):
            script.append(("renamed", c, g))
    goes = lambda path: path in gone and path not in match
    comes = lambda path: path in come and path not in found
    script += [("removed", g, "") for g in gone if goes(g) and not goes(_parent(g))]
    return script + [("added", c, "") for c in come if comes(c) and not comes(_parent(c))]


def outline(fields: dict) -> dict:
    """Of each field its type and, if it has any, what stands within it: as much of a tree as most scripts need."""
    return {f: [type_of(n), outline(n["c"])] if n["c"] else [type_of(n)] for f, n in fields.items()}


def leaves(row: dict, at: str = "", depth: int = 1) -> Iterator[tuple[str, object]]:
    """(path, value) of everything in a row that is not null: objects are gone into, arrays and empty objects are values."""
    for k, v in row.items():
        if isinstance(v, dict) and v and depth < DEEPEST:
            yield from leaves(v, at + k + SEP, depth + 1)
        elif v is not None:
            yield at + k, v


def _kinds(rows: list[dict]) -> dict[str, list[str]]:
    """The kinds of values each leaf has; whole numbers that a double can't hold are long, those beyond 64 bits only text can."""
    out: dict[str, set[str]] = {}
    for r in rows:
        for path, v in leaves(r):
            kind = _KINDS[type(v)]
            if kind == "integer" and abs(v) > 1 << 53:
                kind = "long" if abs(v) < 1 << 63 else "string"
            out.setdefault(path, set()).add(kind)
    return {path: sorted(kinds) for path, kinds in out.items()}


_SUMMARY = "file_key long, file_id long, tab string, feed string, month_no int, fetched_at string, n_rows long, outline string, schema string, kinds string"


def _summarise(batches: Iterator[pd.DataFrame], kinds: bool = True) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, i, tab, feed, month, at, body in zip(*(pdf[c] for c in ("file_key", "file_id", "tab", "feed", "month", "fetched_at", "body"))):
            m = re.match(r"\s*([A-Za-z]{3})[A-Za-z]*[-/ ](\d{4})", month) if isinstance(month, str) else None
            no = int(m[2]) * 12 + MONTHS[m[1].lower()] - 1 if m and m[1].lower() in MONTHS else None
            rows = rows_of(body)
            fields = tree(rows)
            out.append((key, None if pd.isna(i) else int(i), tab, feed, no, at, len(rows), *(json.dumps(x) for x in (outline(fields), fields, _kinds(rows) if kinds else None))))
        yield pd.DataFrame(out, columns=["file_key", "file_id", "tab", "feed", "month_no", "fetched_at", "n_rows", "outline", "schema", "kinds"]).astype({"month_no": "Int32", "file_id": "Int64"})


def _keyed(files: DataFrame) -> DataFrame:
    """The columns of files that matter, with a key that tells any two different files apart, whatever their ids."""
    own = files.select("file_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("tab", "feed")], "month", F.col("fetched_at").cast("string").alias("fetched_at"), "body")
    return own.withColumn("file_key", F.xxhash64("file_id", "tab", "feed", "month", "fetched_at", "body"))


def summarise(files: DataFrame, kinds: bool = False) -> DataFrame:
    """One row per file with its schema tree and bounded content features, and with the kinds of its leaves where asked. A null tab or feed is one without a name."""
    return _keyed(files).mapInPandas(partial(_summarise, kinds=kinds), _SUMMARY)


def monthly(summaries: DataFrame) -> DataFrame:
    """Of each month of a feed the last fetch with rows; snapshots are left out. As many rows per feed as months at most.

    Only keys are compared and written; the trees stay where they are.
    """
    own = summaries.where("month_no IS NOT NULL AND n_rows > 0 AND file_id IS NOT NULL")
    last = own.groupBy("tab", "feed", "month_no").agg(F.max(F.struct("fetched_at", "file_id", "file_key")).alias("x"))
    return materialise(last.select("tab", "feed", "month_no", "x.fetched_at", "x.file_id", "x.file_key"))


def _followed(summaries: DataFrame, main: DataFrame) -> DataFrame:
    own = summaries.select("file_id", "file_key", "tab", "feed", "month_no", "outline", "schema").join(main.select("file_key"), "file_key", "left_semi")
    return own.groupBy("tab", "feed").applyInPandas(_follow, _SCRIPTS)


def merge(old: dict, new: dict) -> dict:
    """The features of a field over all files so far, with the types of the last one that had any."""
    if not new["t"]:
        return old
    if not old["t"]:
        return new
    out = {"t": new["t"], "c": new["c"]}
    for k in ("w", "s"):
        out[k] = dict(Counter(old[k]) + Counter(new[k]))
    return out | {k: old[k] + new[k] for k in ("n", "l", "m", "k")}


def _paths(line: dict, at: str = "") -> Iterator[tuple[str, str | None]]:
    """(path, type) of each node of an outline, parents first."""
    for f, x in line.items():
        yield at + f, x[0]
        if len(x) > 1:
            yield from _paths(x[1], at + f + SEP)


def first_names(line: dict, script: list[tuple[str, str, str]], before: dict[str, str], beside: bool = False) -> dict[str, str]:
    """The first name of each path of a file, from its script against a file whose first names are ``before``.

    No two paths of a file have one first name: what goes on keeps its own
    before what is new; in a file ``beside`` the monthly sequence a field that
    bears a first name has it before one that only goes on. The other has its
    present name, numbered if that is taken too.
    """
    was = {path: old for change, path, old in script if change in ("renamed", "moved")}
    added = {path for change, path, _ in script if change == "added"}
    wish = lambda path: before.get(was.get(path, path))
    rank = lambda path: (path.count(SEP), 0 if beside and (wish(path) or path) == path else 2 if path in added else 1, path)
    out: dict[str, str] = {}
    taken: set[str] = set()
    for path in sorted((path for path, _ in _paths(line)), key=rank):
        up = _parent(path)
        own = wish(path) or (out[up] + SEP + _leaf(path) if up else path)
        first, n = own if own not in taken else path, 2
        while first in taken:
            first, n = f"{own}_{n}", n + 1
        taken.add(first)
        out[path] = first
    return out


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """The changes along one feed, and the first name of every path of each file."""
    out: list[tuple] = []
    root: dict[str, str] = {}
    typed: dict[str, str] = {}
    held: dict[str, list[tuple[int, str]]] = {}
    summed: dict[str, tuple[int, dict]] = {}
    # the very same file may be there twice
    ids, keys, outlines, schemas = pdf.drop_duplicates("file_key").sort_values("month_no")[["file_id", "file_key", "outline", "schema"]].values.T
    lines = [json.loads(x) for x in outlines]
    full = lru_cache(RECENT)(lambda n: json.loads(schemas[n]))
    within = lambda line: line[1] if len(line) > 1 else {}

    def past(f: str) -> dict:
        """What a field has held so far; what was summed up before is kept."""
        n, own = summed.get(root[f], (0, None))
        for k, name in held[root[f]][n:]:
            own = full(k)[name] if own is None else merge(own, full(k)[name])
        summed[root[f]] = len(held[root[f]]), own
        return own

    def ahead(n: int, f: str) -> dict:
        """What a field holds from a file on, as long as its name goes on."""
        last = next((k for k in range(n, len(lines)) if f not in lines[k]), len(lines))
        return reduce(merge, (full(k)[f] for k in range(last - 1, n - 1, -1)))

    for n, (i, key, now) in enumerate(zip(ids, keys, lines)):
        script = []
        if n:
            before = lines[n - 1]
            both = before.keys() & now.keys()
            inner = {f for f in both if within(before[f]) != within(now[f])}
            drift = (before.keys() - both or inner) and (now.keys() - both or inner)
            stub = {"c": {}}
            old = {f: full(n - 1)[f] if f in inner else stub if f in both or not drift else past(f) for f in before}
            new = {f: full(n)[f] if f in inner else stub if f in both or not drift else ahead(n, f) | {"c": full(n)[f]["c"]} for f in now}
            back = {c: ({g for g in before if root[g] == root[c]}, past(c)) for c in now.keys() - both if drift and c in root}
            script = edit_script(old, new, back=back)
        for change, path, was in script:
            out.append((i, key, change, path, was))
        names = first_names(now, script, root)
        root |= names
        for path, kind in _paths(now):
            if SEP not in path:
                if kind:
                    if typed.get(root[path], kind) != kind:
                        out.append((i, key, "retyped", path, ""))
                    typed[root[path]] = kind
                held.setdefault(root[path], []).append((n, path))
            out.append((i, key, "field", path, root[path]))
    own = pd.DataFrame(out, columns=["file_id", "file_key", "change", "field", "old_field"])
    own.insert(0, "tab", pdf["tab"].iloc[0])
    own.insert(1, "feed", pdf["feed"].iloc[0])
    return own


_SCRIPTS = "tab string, feed string, file_id long, file_key long, change string, field string, old_field string"


def feed_scripts(summaries: DataFrame) -> DataFrame:
    """(tab, feed, file_id, file_key, change, field, old_field): the scripts of all files, and a ``field`` row with the first name of each path.

    A feed's summaries are read in order by one task; they are bounded by the
    calendar, whatever share of all files or rows the feed holds. ``summaries``
    must be materialised: it is read twice.
    """
    return _followed(summaries, monthly(summaries))


def schema_changes(files: DataFrame, nested: bool = False) -> DataFrame:
    """(file_id, change, field, old_field): each change of a file against the one of the preceding month of its feed.

    ``change`` is added, removed, renamed, retyped, or, with ``nested``, moved;
    paths within objects are given then too, with dots. Without it a field that
    came out of an object is added, and one that went into an object removed.
    Snapshots and files without rows have no part in it; an empty table gives
    no rows.
    """
    out = feed_scripts(materialise(summarise(files))).where("change <> 'field'").select("file_id", "change", "field", "old_field")
    if nested:
        dots = lambda c: F.translate(c, SEP, ".").alias(c)
        return out.select("file_id", "change", dots("field"), dots("old_field"))
    moved = F.col("change") == "moved"
    ends = F.array(F.struct(F.when(moved, "added").otherwise(F.col("change")).alias("change"), F.col("field"), F.when(moved, "").otherwise(F.col("old_field")).alias("old_field")), F.when(moved, F.struct(F.lit("removed").alias("change"), F.col("old_field").alias("field"), F.lit("").alias("old_field"))))
    return out.select("file_id", F.explode(F.array_compact(ends)).alias("x")).select("file_id", "x.*").where(~F.contains("field", F.lit(SEP)))


def _other_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, line, schema, base_line, base_schema, base_names in zip(*(pdf[c] for c in ("file_key", "outline", "schema", "base_outline", "base_schema", "base_names"))):
            now = json.loads(line)
            script: list[tuple[str, str, str]] = []
            names: dict[str, str] = {}
            if isinstance(base_line, str):
                names = dict(base_names)
                if json.loads(base_line) != now:
                    script = edit_script(json.loads(base_schema), json.loads(schema))
            out += [(key, path, first) for path, first in first_names(now, script, names, True).items()]
        yield pd.DataFrame(out, columns=["file_key", "field", "first"])


def file_names(summaries: DataFrame) -> DataFrame:
    """(file_key, field, first): the first name of every path of every file that has rows, its own script compiled.

    Files that stand beside the monthly sequence (superseded fetches, snapshots,
    months that can't be read) have a script of their own against the file of
    the same month or, without a month, the latest month fetched by then.
    ``summaries`` must be materialised: it is read several times.
    """
    main = monthly(summaries)
    followed = materialise(_followed(summaries, main).where("change = 'field'").select("file_key", "field", F.col("old_field").alias("first")))
    others = summaries.where("n_rows > 0").join(main.select("file_key"), "file_key", "left_anti").dropDuplicates(["file_key"])
    # which file each is compared with: as many rows as a feed has months for each, of a few numbers only
    small = others.select("file_key", "tab", "feed", "month_no", "fetched_at")
    months = main.select("tab", "feed", F.col("month_no").alias("m"), F.col("fetched_at").alias("at"), F.col("file_key").alias("base"))
    rank = F.struct(F.col("m").eqNullSafe(F.col("month_no")).alias("same"), F.coalesce(F.col("at") <= F.col("fetched_at"), F.lit(False)).alias("known"), F.when(F.coalesce(F.col("at") <= F.col("fetched_at"), F.lit(False)), F.col("m")).otherwise(-F.col("m")).alias("m"), F.col("base"))
    chosen = small.join(months, ["tab", "feed"]).groupBy("file_key").agg(F.max(rank).alias("x")).select("file_key", F.col("x.base").alias("base"))
    maps = followed.groupBy(F.col("file_key").alias("base")).agg(F.map_from_entries(F.collect_list(F.struct("field", "first"))).alias("base_names"))
    chosen = materialise(chosen)
    trees = summaries.select(F.col("file_key").alias("base"), F.col("outline").alias("base_outline"), F.col("schema").alias("base_schema"))
    bases = trees.join(chosen.select("base").distinct(), "base", "left_semi").dropDuplicates(["base"]).join(maps, "base")
    beside = others.select("file_key", "outline", "schema").join(chosen, "file_key", "left").join(bases, "base", "left")
    return followed.unionByName(beside.drop("base").mapInPandas(_other_names, "file_key long, field string, first string"))


def _maps(names: DataFrame) -> DataFrame:
    return names.groupBy("file_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "first"))).alias("names"))


def field_values(files: DataFrame, field: str) -> DataFrame:
    """(file_id, value): the string values of one field in all files, snapshots too, under whatever name it is published."""
    names = file_names(materialise(summarise(files))).where(F.col("first") == field)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, body, path in zip(pdf["file_id"], pdf["body"], pdf["field"]):
                out += [(i, v) for r in rows_of(body) for p, v in (leaves(r) if SEP in path else [(path, r.get(path))]) if p == path and isinstance(v, str)]
            yield pd.DataFrame(out, columns=["file_id", "value"]).astype({"file_id": "Int64"})

    return _keyed(files).select("file_id", "file_key", "body").join(names, "file_key").mapInPandas(read, "file_id long, value string")


#: The type of a column by the kinds of its values over all files; any others come as text.
_TYPES = {("integer",): T.LongType(), ("long",): T.LongType(), ("integer", "long"): T.LongType(), ("decimal",): T.DoubleType(), ("decimal", "integer"): T.DoubleType(), ("boolean",): T.BooleanType()}


def one_table(files: DataFrame) -> DataFrame:
    """All rows of all files under the first names of their fields: file_id, row_no and one column per leaf.

    Each file is read through its own script: renamed and moved fields go to
    the column of their first name, those within objects have a path with
    dots. A column whose values are numbers or booleans in all files has that
    type; otherwise strings stay as they are, and other values come as JSON
    text. A field that a file lacks is null; every value of every readable body
    is in the table. Of columns whose names differ by case only, or are called
    like a key column, the later ones get trailing underscores. Unreadable and
    empty bodies have no rows.
    """
    summaries = materialise(summarise(files, kinds=True))
    names = materialise(file_names(summaries))
    kinds = summaries.select("file_key", F.explode(F.from_json("kinds", "map<string,array<string>>")).alias("field", "kinds")).join(names, ["file_key", "field"], "left")
    columns = kinds.groupBy(F.coalesce("first", "field").alias("first")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds")).orderBy("first")
    own = columns.limit(MOST_COLUMNS + 1).collect()
    if len(own) > MOST_COLUMNS:
        raise ValueError(f"the files have more than {MOST_COLUMNS} fields")
    schema = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("row_no", T.IntegerType())])
    place, taken = {}, {"file_id", "row_no"}
    for r in own:
        name = r["first"].replace(SEP, ".")
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        place[r["first"]] = len(schema)
        schema = schema.add(name, _TYPES.get(tuple(r["kinds"]), T.StringType()))
    texts = {n for n, f in enumerate(schema) if isinstance(f.dataType, T.StringType)}
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data: list[list] = [[] for _ in arrow]
            for i, body, known in zip(*(batch.column(c).to_pylist() for c in ("file_id", "body", "names"))):
                own = dict(known or ())
                for n, r in enumerate(rows_of(body)):
                    row: list = [i, n] + [None] * (len(arrow) - 2)
                    for path, v in leaves(r):
                        at = place[own.get(path, path)]
                        row[at] = json.dumps(v, ensure_ascii=False, sort_keys=True) if at in texts and not isinstance(v, str) else v
                    for column, v in zip(data, row):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, arrow)], schema=arrow)

    return _keyed(files).select("file_id", "file_key", "body").join(_maps(names), "file_key", "left").select("file_id", "body", "names").mapInArrow(read, schema)
