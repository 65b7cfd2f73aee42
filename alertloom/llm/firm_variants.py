"""Spellings of one organisation, linked (problem 5).

Each cell is read once into the firm's own words, its trade and its place. The
own words are cut into k+1 segments each, k being the edits that a word may
have, and looked up, position-shifted, in an inverted index of segments that
loses no pair; candidates are verified by banded edit distance.
Names of initials or of one word only are looked up by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..session import joinable, materialise
from .mentions import near, parse

#: An index entry with more names than this is worked off through its commonest name.
HOT_BLOCK = 200
#: Parts of such an entry, which are compared with what that name doesn't cover one by one.
HOT_PARTS = 8
#: A single word of so many letters may be two words joined; from the second number on it must be.
JOINED, SURELY_JOINED = 9, 13
#: Letters of a word from which on it may have both edits.
TWO_EDITS = 6

_PARSED = "name string, node string, kind string, core string, trades array<string>, plot string, pin string, town string"


def _read(names: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in names:
        out = []
        for text in pdf["name"]:
            m = parse(text)
            core = [w for w in m.core if w]
            if m.placeholder or not core:
                continue
            if len(core) == 1 and len(core[0]) <= 3:
                core = list(core[0])
            town = m.towns[0] if m.towns else None
            words = " ".join(core)
            if not m.short and len(core) == 2 and min(map(len, core)) >= 3:
                kind, node = "two", "F " + " ".join(sorted(core))
            elif len(core) > 2 and not m.short:
                kind, words = "one", "".join(core)
                node = "F " + words
            elif len(core) == 1 and len(words) >= SURELY_JOINED:
                kind, node = "one", "F " + words
            else:
                kind, node = "maybe" if len(core) == 1 and len(words) >= JOINED else "short", "S " + " ".join([*sorted(core), "+".join(m.trades), m.plot or "", m.pin or "", town or ""])
            if kind == "two":
                words = node[2:]
            out.append((text, node, kind, words, m.trades, m.plot, m.pin, town))
        yield pd.DataFrame(out, columns=["name", "node", "kind", "core", "trades", "plot", "pin", "town"])


def read_names(names: DataFrame) -> DataFrame:
    """One row per distinct string that names a firm: its node, words, trades and place. Placeholders and texts without a name have none."""
    return names.select("name").where("name IS NOT NULL").distinct().mapInPandas(_read, _PARSED)


def _segments(word: str, k: int) -> set[tuple[int, int, str]]:
    """(length, number, letters) of the k + 1 segments of a word.

    k edits leave one of them whole, but for a swap across a cut, which spoils
    two: the segments after each such swap are there as well, with one edit less
    to come.
    """
    n = len(word)
    at = [n * i // (k + 1) for i in range(k + 2)]
    out = {(n, i, word[at[i] : at[i + 1]]) for i in range(k + 1)}
    for j in range(1, k + 1):
        c = at[j]
        if 0 < c < n and word[c - 1] != word[c]:
            w = word[: c - 1] + word[c] + word[c - 1] + word[c + 1 :]
            # with no edit to come any one segment will do
            out |= {(n, i, w[at[i] : at[i + 1]]) for i in (range(k + 1) if k > 1 else [j])}
    return out


def _lookups(word: str, k: int, longest: int) -> set[tuple[int, int, str]]:
    """Where the segments of a word's variants may lie in it: in words of up to k letters less and ``longest`` letters more, shifted by the edits to the left."""
    m, out = len(word), set()
    for n in range(max(m - k, 1), m + longest + 1):
        at, d = [n * i // (k + 1) for i in range(k + 2)], m - n
        for i in range(k + 1):
            for s in range(-i, i + 1):
                if abs(d - s) <= k - i and at[i] + s >= 0 and at[i + 1] + s <= m:
                    out.add((n, i, word[at[i] + s : at[i + 1] + s]))
    return out


def _key(*parts: str | tuple[int, int, str]) -> int:
    return xxhash.xxh64_intdigest("\x1f".join([x if isinstance(x, str) else f"{x[0]}\x1e{x[1]}\x1e{x[2]}" for x in parts])) - (1 << 63)


def _keys(core: str, kind: str, probe: bool) -> set[int]:
    """Index keys of a name, or the keys under which its variants may stand.

    Two words have one edit each ("w": a segment of either), or one word is
    exact ("x": that word and a segment of the other). As the order of the words
    doesn't count, keys have none, and only the longer looks up the shorter. All
    words joined have two edits ("j"); two names of two words don't meet there.
    """
    if kind != "two":
        return {_key("j", x) for x in (_lookups(core, 2, 2) if probe else _segments(core, 2))}
    a, b = core.split(" ")
    if probe:
        pairs = [(x, y) for x in _lookups(a, 1, 1) for y in _lookups(b, 1, 1) if x[0] + y[0] <= len(a) + len(b)]
        others = [(u, x) for u, v in ((a, b), (b, a)) if len(v) >= TWO_EDITS for x in _lookups(v, 2, 0)]
        joined = set()
    else:
        pairs = [(x, y) for x in _segments(a, 1) for y in _segments(b, 1)]
        others = [(u, x) for u, v in ((a, b), (b, a)) if len(v) >= TWO_EDITS - 2 for x in _segments(v, 2)]
        joined = _segments(a + b, 2) | _segments(b + a, 2)
    return {_key("w", x, y) if x < y else _key("w", y, x) for x, y in pairs} | {_key("x", u, x) for u, x in others} | {_key("j", x) for x in joined}


def _emit(probe: bool):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, c, s) for c, d, s in zip(pdf["core"], pdf["kind"], pdf["support"]) for k in _keys(c, d, probe)]
            yield pd.DataFrame(rows, columns=["k", "core", "support"]).iloc[:, : 2 if probe else 3]

    return run


def same_core(a: str, b: str) -> bool:
    """Whether two names' own words are within two edits in all, in either order, joined or not; short words within one."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) == 2:
        for u, v in ((y[0], y[1]), (y[1], y[0])):
            d, e = near(x[0], u, 2), near(x[1], v, 2)
            if d + e <= 2 and all(n < 2 or len(w) >= TWO_EDITS for n, w in ((d, x[0]), (e, x[1]))):
                return True
        return False
    if len(x) == len(y) == 1:
        return near(a, b, 2) <= 2
    one, two = (a, y) if len(x) == 1 else (b, x)
    return near(one, two[0] + two[1], 2) <= 2 or near(one, two[1] + two[0], 2) <= 2


def nearly_same_core(a: str, b: str) -> bool:
    """Whether each of two names' two words is within two edits, in either order: enough only for firms at one place."""
    x, y = a.split(" "), b.split(" ")
    return len(x) == len(y) == 2 and any(near(x[0], u, 2) <= 2 and near(x[1], v, 2) <= 2 and min(map(len, (*x, u, v))) >= 5 for u, v in ((y[0], y[1]), (y[1], y[0])))


@F.pandas_udf(T.BooleanType())
def _nearly_same(a: pd.Series, b: pd.Series, ta: pd.Series, tb: pd.Series, pa: pd.Series, pb: pd.Series) -> pd.Series:
    return pd.Series([nearly_same_core(x, y) and _same_town(s, t, p, q) for x, y, s, t, p, q in zip(a, b, ta, tb, pa, pb)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _same_core(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_core(x, y) for x, y in zip(a, b)], dtype=bool)


def _perhaps_same(a: str, b: str) -> F.Column:
    """What two edits with swaps leave true of the joined words: up to four edits without, in either order. Costs less than same_core, which decides."""
    joined = lambda x: F.translate(x, " ", "")
    turned = lambda x: F.concat(F.substring_index(x, " ", -1), F.substring_index(x, " ", 1))
    either = F.when(F.contains(F.col(b), F.lit(" ")), F.levenshtein(joined(a), turned(b), 4)).otherwise(F.levenshtein(turned(a), F.col(b), 4))
    return (F.levenshtein(joined(a), joined(b), 4) >= 0) | (either >= 0)


def fits(short: str, full: str) -> bool:
    """Whether a name of initials, beginnings or one word can stand for a full one."""
    x, y = short.split(" "), full.split(" ")
    begins = lambda s, w: s[0] == w[0] if len(s) == 1 else w.startswith(s) or near(s, w, 1) <= 1 or len(s) >= 3 and near(s, w[: len(s)], 1) <= 1
    if len(y) == 1 and len(y[0]) >= JOINED:
        return any(begins(s, y[0]) for s in x) if len(x) == 1 else any(begins(p, y[0]) and (len(q) == 1 or near(q, y[0][-len(q) :], 1) <= 1) for p, q in (x[:2], x[1::-1]))
    if len(x) == 1:
        return len(x[0]) >= 3 and any(begins(x[0], w) for w in y)
    if len(x) == 2 and len(y) == 2:
        return begins(x[0], y[0]) and begins(x[1], y[1]) or begins(x[1], y[0]) and begins(x[0], y[1])
    return False


def _same_town(s: str | None, t: str | None, p: str | None, q: str | None) -> bool:
    return s is not None and t is not None and near(s, t, 2) <= 2 or p is not None and p == q


def _fits_either(a: str, b: str, b_short: bool) -> bool:
    return fits(a, b) or b_short and fits(b, a)


@F.pandas_udf(T.BooleanType())
def _fits(a: pd.Series, b: pd.Series, kind: pd.Series, ta: pd.Series, tb: pd.Series, pa: pd.Series, pb: pd.Series) -> pd.Series:
    return pd.Series([_fits_either(x, y, k in ("short", "maybe")) and _same_town(s, t, p, q) for x, y, k, s, t, p, q in zip(a, b, kind, ta, tb, pa, pb)], dtype=bool)


def _agree(x: str, y: str) -> F.Column:
    return (F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y)


def core_links(cores: DataFrame) -> DataFrame:
    """(a, b): names whose own words are variants of each other.

    ``cores`` has (core, kind, trades, support); without trades none contradict.
    The names of a hot index entry are compared with its commonest name first.
    Those that are its variants and whose trades don't contradict its own are
    covered: they are linked through it, so that one organisation with very
    many spellings makes no square of pairs. Every other name is compared with
    all names of the entry, covered or not.
    """
    trades = cores.select("core", "trades") if "trades" in cores.columns else cores.select("core", F.array().cast("array<string>").alias("trades"))
    cores = cores.select("core", "kind", "support")
    n_cores = cores.count()
    index = materialise(cores.mapInPandas(_emit(False), "k long, core string, support long"))
    probes = cores.mapInPandas(_emit(True), "k long, core string")
    heads = materialise(index.groupBy("k").agg(F.count("*").alias("n"), F.max(F.struct("support", "core")).alias("m")).where(F.col("n") > HOT_BLOCK).select("k", F.col("m.core").alias("hub")))
    n_heads = heads.count()
    is_hot = n_heads > 0
    if is_hot:
        probes = materialise(probes)
    left, right = probes.select("k", F.col("core").alias("a")), index.select("k", F.col("core").alias("b"))
    verified = lambda met: met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().where(_perhaps_same("a", "b")).where(_same_core("a", "b"))
    links = verified(left.join(joinable(right.join(joinable(heads, n_heads), "k", "left_anti") if is_hot else right, index.count()), "k"))
    if not is_hot:
        return links
    hot_left, hot_right = materialise(left.join(joinable(heads, n_heads), "k")), materialise(right.join(joinable(heads, n_heads), "k"))
    n_hot = hot_right.count()
    to_hub = hot_left.select(F.col("a").alias("core"), "hub").union(hot_right.select("b", "hub")).distinct()
    to_hub = to_hub.join(joinable(trades, n_cores), "core").join(joinable(trades.select(F.col("core").alias("hub"), F.col("trades").alias("hub_trades")), n_cores), "hub").where(_agree("trades", "hub_trades"))
    covered = materialise(to_hub.where(_same_core(F.least("core", "hub"), F.greatest("core", "hub"))).select("core", "hub"))
    n_covered = covered.count()
    split = lambda side, x, how: side.join(joinable(covered.withColumnRenamed("core", x), n_covered), [x, "hub"], how).select("k", x)
    bare_a, bare_b = split(hot_left, "a", "left_anti"), split(hot_right, "b", "left_anti")
    # the entry's names in parts, each with all names that the hub doesn't cover
    parts = F.explode(F.array(*map(F.lit, range(HOT_PARTS)))).alias("part")
    part = lambda x: F.pmod(F.xxhash64(x), F.lit(HOT_PARTS)).cast("int").alias("part")
    among = bare_a.select("k", "a", parts).join(joinable(hot_right.select("k", "b", part("b")), n_hot), ["k", "part"]).select("a", "b")
    among = among.unionByName(split(hot_left, "a", "left_semi").select("k", "a", part("a")).join(joinable(bare_b.select("k", "b", parts), HOT_PARTS * n_hot), ["k", "part"]).select("a", "b"))
    through = covered.where("core <> hub").select(F.least("core", "hub").alias("a"), F.greatest("core", "hub").alias("b"))
    return links.unionByName(through).unionByName(verified(among)).distinct()


def firm_groups(names: DataFrame) -> DataFrame:
    """(name, firm): every distinct string that names an organisation, with its group.

    Strings with the same own words, in any order, are one organisation
    whatever stands beside them; others are linked if their words are variants
    and their trades don't contradict. Initials and single words are linked to
    a full name, or to each other, at the same plot and town; there full names
    that nothing else is close to may differ by two edits in each word. Null, empty and
    placeholder names are in no group; an empty table gives no rows.
    """
    read = materialise(read_names(names))
    # how many names there are bounds all that is made of them, but for what stands for several keys
    by_kind = {r["kind"]: r["n"] for r in read.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n_names = sum(by_kind.values())
    is_short = F.col("kind").isin("short", "maybe")
    full = read.where(~is_short)
    kinds = F.when(F.col("kind") == "maybe", "one").otherwise(F.col("kind")).alias("kind")
    cores = read.where("kind <> 'short'").select("core", kinds, F.explode_outer("trades").alias("trade")).groupBy("core", "kind").agg(F.collect_set("trade").alias("trades"))
    # what many names share is spelt right: a name's support is how many have its words
    words = cores.select("core", F.explode(F.split("core", " ")).alias("w"))
    support = words.join(joinable(words.groupBy("w").agg(F.count("*").alias("n")), 2 * n_names), "w").groupBy("core").agg(F.sum("n").alias("support"))
    cores = materialise(cores.join(joinable(support, n_names), "core"))
    sides = cores.select(F.col("core").alias("a"), F.col("trades").alias("ta")), cores.select(F.col("core").alias("b"), F.col("trades").alias("tb"))
    links = core_links(cores).join(joinable(sides[0], n_names), "a").join(joinable(sides[1], n_names), "b").where(_agree("ta", "tb"))
    links = materialise(links.select(F.concat(F.lit("F "), "a").alias("a"), F.concat(F.lit("F "), "b").alias("b")))
    # a single word that turns out to be two joined goes with them
    maybe = read.where("kind = 'maybe'").select(F.col("node").alias("n"), F.concat(F.lit("F "), "core").alias("f")).distinct()
    joined = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(joinable(maybe, by_kind.get("maybe", 0)), F.col("a") == F.col("f")).select(F.col("n").alias("a"), "b")
    own = lambda df: df.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    first = materialise(connected_components(links.unionByName(joined).unionByName(own(full))))
    # by place: names of initials or one word, and names that nothing is close enough to elsewhere. An
    # organisation is there with its commonest name of two words only, and only names with the same first letters meet.
    common = first.join(joinable(cores.select(F.concat(F.lit("F "), "core").alias("node"), "core", "support"), n_names), "node").groupBy("component").agg(F.max(F.struct(F.contains("core", F.lit(" ")).alias("two"), "support", "core")).alias("m")).select("component", F.col("m.core").alias("core"))
    letters = lambda c: F.array_sort(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, 1)))
    town = F.col("town")
    near_keys = F.array(F.concat(F.lit("n"), "pin"), F.concat(F.lit("p"), F.substring(town, 1, 4)), F.concat(F.lit("s"), F.substring(town, -4, 4)))
    placed = read.where("plot IS NOT NULL").select("node", "kind", "core", "trades", "plot", "pin", "town").distinct().withColumn("k", F.explode(F.array_compact(near_keys)))
    short = placed.where(is_short).withColumn("i", F.array_join(letters("core"), ""))
    firms = placed.where(~is_short).drop("core").join(joinable(first, n_names), "node").join(joinable(common, n_names), "component").select(F.col("component").alias("node"), F.when(F.contains("core", F.lit(" ")), "two").otherwise("one").alias("kind"), "core", "trades", "plot", "pin", "town", "k").distinct()
    firms = materialise(firms.withColumn("i", F.explode(F.array_distinct(F.concat(F.array(F.array_join(letters("core"), "")), letters("core"))))))
    # a name stands in three places at most
    n_placed = firms.count() + 3 * n_names
    side = lambda df, x: df.select("plot", "k", "i", *[F.col(c).alias(n + x) for c, n in (("node", "n"), ("core", "c"), ("kind", "k"), ("trades", "t"), ("town", "w"), ("pin", "p"))])
    met = lambda a, b: side(a, "a").join(joinable(side(b, "b"), n_placed), ["plot", "k", "i"]).where((F.col("na") != F.col("nb")) & _agree("ta", "tb")).drop("plot", "k", "i").distinct()
    by_place = met(short, firms.unionByName(short.select(firms.columns)))
    by_place = materialise(by_place.where(_fits("ca", "cb", "kb", "wa", "wb", "pa", "pb")).select(F.col("na").alias("a"), F.col("nb").alias("b"), F.col("kb").isin("short", "maybe").alias("s")).distinct())
    alone = first.groupBy("component").agg(F.count("*").alias("n")).where("n = 1").select(F.col("component").alias("node"))
    pairs = firms.where("kind = 'two' AND length(i) = 2")
    loose = met(pairs.join(joinable(alone, n_names), "node", "left_semi"), pairs).where(_nearly_same("ca", "cb", "wa", "wb", "pa", "pb")).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    # a short name that fits several organisations stays with none of them
    stands = by_place.where("NOT s").groupBy("a").agg(F.countDistinct("b").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    known = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = connected_components(known.unionByName(stands).unionByName(by_place.where("s").select("a", "b")).unionByName(loose).unionByName(own(read)))
    return read.select("name", "node").join(joinable(groups, n_names), "node").select("name", F.col("component").alias("firm"))


def firm_pairs(groups: DataFrame) -> DataFrame:
    """(name_a, name_b): every pair of strings of one organisation, the smaller first."""
    groups = materialise(groups)
    return groups.select("firm", F.col("name").alias("name_a")).join(joinable(groups.select("firm", F.col("name").alias("name_b")), groups.count()), "firm").where("name_a < name_b").select("name_a", "name_b")
