"""Search over records: exact batches, substrings, ranked words, and all of them (Q1-Q7)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import batch_key

FIELDS = {"drug": 3.0, "manufacturer": 1.0, "canonical": 1.0}
#: Parameters of the usual BM25 formula, and how much prefix and fuzzy matches count beside exact ones.
K1, B, PREFIX_WEIGHT, FUZZY_WEIGHT, FUZZINESS = 1.2, 0.7, 0.375, 0.45, 0.2


def hits(records: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, drug, batch, manufacturer, canonical, month): what is searched, the company's name beside its spelling."""
    names = companies.select(F.col("id").alias("manufacturer_id"), F.col("canonical_name").alias("canonical"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return records.join(names, "manufacturer_id", "left").select("id", empty("drug_name_raw").alias("drug"), empty("batch_number").alias("batch"), empty("manufacturer_raw").alias("manufacturer"), empty("canonical").alias("canonical"), empty("alert_month").alias("month"))


def words(c: Column) -> Column:
    """A text's words in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))


def postings(of: DataFrame) -> DataFrame:
    """Q1: (term, field, id, tf, len): how often each field of each record has each word."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("w")) for f in FIELDS])
    long_ = of.select("id", F.explode(each).alias("x")).select("id", "x.field", F.size("x.w").alias("len"), F.explode("x.w").alias("term"))
    return long_.groupBy("term", "field", "id").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def by_batch(of: DataFrame, query: str) -> DataFrame:
    """Q3: the records whose batch number has the same letters and digits; a query without any finds none."""
    q = batch_key(F.lit(query.strip()))
    return of.where((batch_key(F.col("batch")) == q) & (q != ""))


def by_company(of: DataFrame, query: str) -> DataFrame:
    """Q4: the records whose manufacturer, as spelt or resolved, has the query in it; an empty query finds none."""
    q = F.lit(query.strip().lower())
    return of.where((q != "") & (F.contains(F.lower("manufacturer"), q) | F.contains(F.lower("canonical"), q)))


def query_words(query: str) -> list[str]:
    """The words of a query."""
    out, word = [], ""
    for ch in query.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def matching_terms(index: DataFrame, query: str) -> DataFrame:
    """(term, q, weight): indexed words that equal a query's word, begin with it, or are within a fifth of its length in edits."""
    terms = index.select("term").distinct()
    found = None
    for q in dict.fromkeys(query_words(query)):
        d = F.levenshtein("term", F.lit(q), max(0, round(FUZZINESS * len(q))))
        extra = F.length("term") - len(q)
        weight = F.when(F.col("term") == q, 1.0).when(F.startswith("term", F.lit(q)), PREFIX_WEIGHT * F.length("term") / (F.length("term") + 0.3 * extra)).when(d >= 0, FUZZY_WEIGHT * F.length("term") / (F.length("term") + d))
        one = terms.select("term", F.lit(q).alias("q"), weight.alias("weight")).where("weight IS NOT NULL")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else terms.select("term", F.lit("").alias("q"), F.lit(0.0).alias("weight")).limit(0)


def by_words(of: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """Q2: (id, score) of the records that have any word of the query, in any field, by the BM25 formula; drug names count threefold."""
    totals = index.groupBy("field").agg(F.countDistinct("id").alias("docs"), (F.sum("tf") / F.countDistinct("id")).alias("mean"))
    mine = matching_terms(index, query).join(index, "term")
    df = mine.groupBy("term", "field").agg(F.countDistinct("id").alias("df"))
    at = mine.join(df, ["term", "field"]).join(totals, "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    boost = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])[F.col("field")]
    return at.groupBy("id").agg(F.round(F.sum(F.col("weight") * boost * idf * tf), 6).alias("score")).join(of.select("id").distinct(), "id", "left_semi")


def found(of: DataFrame, index: DataFrame, query: str, mode: str = "all") -> DataFrame:
    """(id, x (way, s)): every record that a query finds in a mode, with the best way it was found: batch (0), words (1, by score), company (2)."""
    ways = {
        "batch": lambda: by_batch(of, query).select("id", F.lit(0).alias("way"), F.lit(0.0).alias("score")),
        "drug": lambda: by_words(of, index, query).select("id", F.lit(1).alias("way"), "score"),
        "manufacturer": lambda: by_company(of, query).select("id", F.lit(2).alias("way"), F.lit(0.0).alias("score")),
    }
    chosen = list(ways) if mode == "all" else [mode]
    out = ways[chosen[0]]()
    for w in chosen[1:]:
        out = out.unionByName(ways[w]())
    if not query.strip():
        out = out.limit(0)
    return out.groupBy("id").agg(F.min(F.struct("way", (-F.col("score")).alias("s"))).alias("x"))


def totals(of: DataFrame, index: DataFrame, query: str, mode: str = "all") -> DataFrame:
    """Q5: one row: how many records are found, and how many of them by their words."""
    return found(of, index, query, mode).agg(F.count("*").alias("found"), F.count_if(F.col("x.way") == 1).alias("by_words"))


def search(of: DataFrame, index: DataFrame, query: str, mode: str = "all", limit: int = 100) -> DataFrame:
    """Q5, U4: (place, id) of the first ``limit`` records in a mode: drug, batch, manufacturer or all.

    In all modes batches come first, then words by score, then companies, each
    record once. A blank query finds none.
    """
    top = found(of, index, query, mode).orderBy("x.way", "x.s", "id").limit(limit)
    return top.select(F.row_number().over(Window.orderBy("x.way", "x.s", "id")).alias("place"), "id")


def page(results: DataFrame, number: int, size: int = 25) -> DataFrame:
    """Q6: one page of numbered results."""
    return results.where(F.col("place").between(number * size + 1, (number + 1) * size))


def fuzzy_distance(query: str) -> int:
    """How many edits a word of a query may be away."""
    return math.floor(FUZZINESS * len(query) + 0.5)
