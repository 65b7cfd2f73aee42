"""Free-entered values mapped to the entries of a reference list (problem 4). SQL only.

Each distinct value is looked at once. Its words, and the words of the
reference list, meet in a partition-based pigeonhole join: a reference word is
cut into k+1 segments, one of which must stand unchanged, shifted by k places at
most, in any word within k edits; the built-in levenshtein verifies. Values
without a single entry are reported through an anti-join with an empty entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import materialise

#: Words that say nothing about which entry is meant.
STOP_WORDS = ["the", "at", "of", "and", "in", "for"]
#: Usual other forms of the words in names of laboratories.
WORD_FORMS = {
    "analytical": "analysis", "analytic": "analysis", "analysts": "analyst", "drugs": "drug", "foods": "food", "labs": "laboratory", "laboratories": "laboratory",
    "laboratry": "laboratory", "labortory": "laboratory", "medicine": "medicines", "test": "testing", "tests": "testing", "testng": "testing", "govt": "government",
}
#: Usual short and former names of Indian states.
STATE_ALIASES = {
    "hp": "Himachal Pradesh", "himachal": "Himachal Pradesh", "uk": "Uttarakhand", "ua": "Uttarakhand", "uttaranchal": "Uttarakhand", "uttrakhand": "Uttarakhand",
    "guj": "Gujarat", "gj": "Gujarat", "gujrat": "Gujarat", "mh": "Maharashtra", "mah": "Maharashtra", "maharastra": "Maharashtra", "pb": "Punjab", "panjab": "Punjab",
    "hr": "Haryana", "hariyana": "Haryana", "up": "Uttar Pradesh", "ts": "Telangana", "tg": "Telangana", "telengana": "Telangana", "ap": "Andhra Pradesh", "andhra": "Andhra Pradesh",
    "ka": "Karnataka", "kar": "Karnataka", "tn": "Tamil Nadu", "mp": "Madhya Pradesh", "wb": "West Bengal", "bengal": "West Bengal", "sk": "Sikkim", "kl": "Kerala", "ker": "Kerala", "kerela": "Kerala",
    "rj": "Rajasthan", "raj": "Rajasthan", "rajsthan": "Rajasthan", "od": "Odisha", "or": "Odisha", "orissa": "Odisha", "as": "Assam", "asom": "Assam", "br": "Bihar", "jh": "Jharkhand",
    "cg": "Chhattisgarh", "ct": "Chhattisgarh", "chattisgarh": "Chhattisgarh", "chhatisgarh": "Chhattisgarh", "dl": "Delhi", "dilli": "Delhi", "newdelhi": "Delhi", "nctofdelhi": "Delhi", "nct": "Delhi",
    "ga": "Goa", "jk": "Jammu and Kashmir", "jandk": "Jammu and Kashmir", "kashmir": "Jammu and Kashmir", "jammu": "Jammu and Kashmir", "jammukashmir": "Jammu and Kashmir",
    "py": "Puducherry", "pondicherry": "Puducherry", "pondichery": "Puducherry", "ch": "Chandigarh", "tr": "Tripura", "mn": "Manipur", "ml": "Meghalaya", "nl": "Nagaland", "mz": "Mizoram", "ar": "Arunachal Pradesh", "arunachal": "Arunachal Pradesh",
}

#: Words of free text against words of a list, k = 2 edits: (word, entry, d).
PIGEONHOLE = """
WITH shape AS (
  SELECT DISTINCT entry, length(entry) AS len, least({k}, greatest(0, length(entry) - 3)) AS k FROM {entries}
), cut AS (
  SELECT entry, len, k, i, 1 + (i * len) div (k + 1) AS at, ((i + 1) * len) div (k + 1) - (i * len) div (k + 1) AS size
  FROM shape LATERAL VIEW explode(sequence(0, k)) AS i
), segments AS (
  SELECT entry, len, k, i, at, size, substring(entry, at, size) AS seg FROM cut
), probes AS (
  SELECT DISTINCT s.len + d AS word_len, s.len, s.k, s.i, greatest(1, s.at + shift) AS at, s.size
  FROM (SELECT DISTINCT len, k, i, at, size FROM segments) AS s
  LATERAL VIEW explode(sequence(-k, k)) AS d LATERAL VIEW explode(sequence(-k, k)) AS shift
), words AS (
  SELECT DISTINCT word FROM {words}
), looked AS (
  SELECT DISTINCT w.word, p.len, p.k, p.i, substring(w.word, p.at, p.size) AS seg
  FROM words AS w JOIN probes AS p ON length(w.word) = p.word_len
), met AS (
  SELECT DISTINCT l.word, s.entry, s.k FROM looked AS l JOIN segments AS s ON l.len = s.len AND l.k = s.k AND l.i = s.i AND l.seg = s.seg
)
SELECT word, entry, d FROM (SELECT word, entry, levenshtein(word, entry, k) AS d FROM met) WHERE d >= 0
"""

LAB_VALUES = """
SELECT value, split(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(value), "['’.`]", ''), '[^\\\\p{{L}}\\\\p{{N}}]+', ' ')), '\\\\b(\\\\p{{L}}) (?=\\\\p{{L}}\\\\b)', '$1'), '\\\\s+', ' ')), ' ') AS parts
FROM (SELECT DISTINCT value FROM {raw})
"""

#: Single words and, as blanks get displaced, neighbours joined.
LAB_WORDS = """
SELECT DISTINCT value, parts[i] AS word, 1 AS n FROM {values} LATERAL VIEW explode(sequence(0, size(parts) - 1)) AS i WHERE parts[i] <> ''
UNION ALL
SELECT DISTINCT value, concat(parts[i], parts[i + 1]) AS word, 2 AS n FROM {values} LATERAL VIEW explode(sequence(0, size(parts) - 2)) AS i WHERE size(parts) > 1
"""

#: Each laboratory's kind (its name without the town), the words of it, and their initials.
LAB_ENTRIES = """
SELECT lab_name, replace(lower(town), ' ', '') AS town, kind, filter(split(kind, ' '), w -> NOT array_contains({stop}, w) AND w <> '') AS kind_words
FROM (SELECT lab_name, town, trim(regexp_replace(regexp_replace(lower(replace(lab_name, town, '')), "['’.`]", ''), '[^\\\\p{{L}}\\\\p{{N}}]+', ' ')) AS kind FROM {labs} WHERE lab_name IS NOT NULL AND town IS NOT NULL)
"""

#: A word stands for a longer one if it is its beginning, or its letters with the first one, in order.
ABBREVIATIONS = """
SELECT DISTINCT w.word, e.entry FROM (SELECT DISTINCT word FROM {words}) AS w JOIN (SELECT DISTINCT entry FROM {entries}) AS e ON substring(w.word, 1, 1) = substring(e.entry, 1, 1)
WHERE w.word = e.entry
   OR length(w.word) >= 2 AND length(w.word) < length(e.entry) AND e.entry RLIKE concat('^', regexp_replace(w.word, '(.)', '$1.*'))
   OR length(w.word) >= 5 AND substring(w.word, 1, 5) = substring(e.entry, 1, 5)
   OR length(w.word) BETWEEN 3 AND 4 AND e.entry LIKE concat(substring(w.word, 1, 3), '%') AND levenshtein(w.word, substring(e.entry, 1, length(w.word)), 1) >= 0
"""

LAB_TOWNS = """
SELECT value, town FROM (
  SELECT w.value, t.entry AS town, t.d, min(t.d) OVER (PARTITION BY w.value) AS least, w.n FROM {words} AS w JOIN {close} AS t ON w.word = t.word
) WHERE d = least GROUP BY value, town
"""

LAB_KINDS = """
WITH kinds AS (SELECT DISTINCT kind, kind_words, array_join(transform(kind_words, w -> substring(w, 1, 1)), '') AS initials FROM {entries}),
need AS (SELECT kind, need_word FROM kinds LATERAL VIEW explode(array_distinct(kind_words)) AS need_word),
sizes AS (SELECT kind, count(*) AS n FROM need GROUP BY kind),
spelt AS (
  SELECT w.value, n.kind FROM {words} AS w JOIN {meaning} AS m ON w.word = m.word JOIN need AS n ON m.entry = n.need_word JOIN sizes AS s ON n.kind = s.kind
  GROUP BY w.value, n.kind HAVING count(DISTINCT n.need_word) = max(s.n)
),
short AS (SELECT w.value, k.kind FROM {words} AS w JOIN kinds AS k ON w.word = k.initials)
SELECT value, kind FROM spelt UNION SELECT value, kind FROM short
"""

LAB_PARTS = """
SELECT t.value, e.lab_name FROM {towns} AS t JOIN {kinds} AS k ON t.value = k.value JOIN {entries} AS e ON e.town = t.town AND e.kind = k.kind
"""

WHOLE_FORMS = "array(concat(replace(kind, ' ', ''), town), concat(town, replace(kind, ' ', '')), concat('the', replace(kind, ' ', ''), town))"

#: Whole names without blanks, town first or last: blanks displaced within the words of a kind.
LAB_WHOLE = """
SELECT DISTINCT v.value, e.lab_name FROM (SELECT value, array_join(parts, '') AS word FROM {values}) AS v JOIN {close} AS c ON v.word = c.word
JOIN (SELECT lab_name, whole FROM {entries} LATERAL VIEW explode(""" + WHOLE_FORMS + """) AS whole) AS e ON e.whole = c.entry
"""

#: A value means an entry if exactly one is found by its parts, or else as a whole.
ONE_ENTRY = """
WITH found AS (
  SELECT value, max(IF(way = 1, n, 0)) AS n1, max(IF(way = 1, entry, NULL)) AS e1, max(IF(way = 2, n, 0)) AS n2, max(IF(way = 2, entry, NULL)) AS e2
  FROM (SELECT value, way, count(DISTINCT entry) AS n, min(entry) AS entry FROM {hits} GROUP BY value, way) GROUP BY value
)
SELECT value, CASE WHEN n1 = 1 THEN e1 WHEN n1 = 0 AND n2 = 1 THEN e2 END AS canonical FROM found WHERE n1 = 1 OR n1 = 0 AND n2 = 1
"""

STATE_PARTS = """
SELECT DISTINCT value, part FROM (
  SELECT value, regexp_replace(regexp_replace(regexp_replace(lower(p), '&', ' and '), '^\\\\s*state\\\\s+of\\\\s+|\\\\s+state\\\\s*$|\\\\s+india\\\\s*$', ' '), '[^\\\\p{{L}}]+', '') AS part
  FROM (SELECT DISTINCT value FROM {raw}) LATERAL VIEW explode(split(value, '(?i)[,;/()|\\\\n]|\\\\s+or\\\\s+')) AS p
) WHERE part <> ''
"""

STATE_NAMES = """
SELECT state_name, replace(lower(state_name), ' ', '') AS entry FROM {states} WHERE state_name IS NOT NULL
"""

STATE_HITS = """
WITH alias AS (
  SELECT a.word, n.state_name FROM (SELECT explode({alias}) AS (word, state)) AS a JOIN {names} AS n ON n.state_name = a.state
), short AS (
  SELECT DISTINCT p.part AS word, n.state_name FROM {parts} AS p JOIN {names} AS n ON substring(p.part, 1, 3) = substring(n.entry, 1, 3)
  WHERE length(p.part) >= 5 AND (n.entry LIKE concat(p.part, '%') OR p.part LIKE '%pr' AND n.entry = concat(substring(p.part, 1, length(p.part) - 2), 'pradesh'))
), cut AS (
  SELECT p.part AS word, min(n.state_name) AS state_name FROM {parts} AS p JOIN {names} AS n ON substring(p.part, 1, 1) = substring(n.entry, 1, 1)
  WHERE length(p.part) BETWEEN 3 AND length(n.entry) - 1 AND n.entry RLIKE concat('^', regexp_replace(p.part, '(.)', '$1.*')) GROUP BY p.part HAVING count(DISTINCT n.state_name) = 1
), close AS (
  SELECT c.word, n.state_name, c.d FROM {close} AS c JOIN {names} AS n ON n.entry = c.entry
  WHERE c.d < 2 OR length(c.entry) > 6 OR array_sort(split(c.word, '')) = array_sort(split(c.entry, ''))
), all AS (
  SELECT word, state_name, 0 AS d FROM alias UNION ALL SELECT word, state_name, 1 FROM short WHERE word NOT IN (SELECT word FROM alias)
  UNION ALL SELECT word, state_name, 3 FROM cut WHERE word NOT IN (SELECT word FROM alias)
  UNION ALL SELECT word, state_name, d FROM close WHERE word NOT IN (SELECT word FROM alias)
), best AS (
  SELECT word, state_name FROM (SELECT word, state_name, d, min(d) OVER (PARTITION BY word) AS least FROM all) WHERE d = least
)
SELECT DISTINCT p.value, 1 AS way, b.state_name AS entry FROM {parts} AS p JOIN best AS b ON p.part = b.word
"""

#: Values that hit nothing, or several entries, come out through the anti-join.
REPORT = """
WITH raw AS (SELECT value FROM {raw} GROUP BY value)
SELECT value, canonical FROM {one} UNION ALL SELECT r.value, '' AS canonical FROM raw AS r LEFT ANTI JOIN {one} AS o ON r.value = o.value
"""


def pigeonhole(spark: SparkSession, words: DataFrame, entries: DataFrame, k: int = 2) -> DataFrame:
    """(word, entry, d): all pairs within k edits, fewer for entries under five letters."""
    return spark.sql(PIGEONHOLE.replace("{k}", str(int(k))), words=words, entries=entries)


def map_labs(spark: SparkSession, raw: DataFrame, labs: DataFrame, k: int = 2) -> DataFrame:
    """(value, canonical) for each distinct value of ``raw``; an empty string if it means no single laboratory.

    A value means a laboratory if a word of it is within k edits of the town
    of the list, and all words of the laboratory's kind, abbreviated or
    misspelt, or their initials, stand in it.
    """
    sql = spark.sql
    stop = "array(" + ",".join(f"'{w}'" for w in STOP_WORDS) + ")"
    values = materialise(sql(LAB_VALUES, raw=raw))
    words = materialise(sql(LAB_WORDS, values=values))
    entries = sql(LAB_ENTRIES.replace("{stop}", stop), labs=labs)
    singles = words.where("n = 1")
    towns = sql("SELECT DISTINCT town AS entry FROM {e}", e=entries)
    kind_words = sql("SELECT DISTINCT w AS entry FROM {e} LATERAL VIEW explode(kind_words) AS w", e=entries)
    forms = "map(" + ",".join(f"'{a}','{b}'" for a, b in WORD_FORMS.items()) + ")"
    forms = sql(f"SELECT f.form, f.entry FROM (SELECT explode({forms}) AS (form, entry)) AS f JOIN {{w}} AS w ON f.entry = w.entry UNION SELECT entry AS form, entry FROM {{w}}", w=kind_words)
    # one join for the words of towns, of kinds and for whole names: what meets is told apart by the entry
    every_word = sql("SELECT word FROM {w} UNION SELECT array_join(parts, '') AS word FROM {v}", w=words, v=values)
    every_entry = sql("SELECT entry FROM {t} UNION SELECT form FROM {f} UNION SELECT whole FROM {e} LATERAL VIEW explode(" + WHOLE_FORMS + ") AS whole", t=towns, f=forms, e=entries)
    close = materialise(pigeonhole(spark, every_word, every_entry, k))
    meaning = sql("SELECT word, entry FROM {a} UNION SELECT c.word, f.entry FROM {c} AS c JOIN {f} AS f ON c.entry = f.form", a=sql(ABBREVIATIONS, words=singles, entries=kind_words), c=close, f=forms)
    kinds = materialise(sql(LAB_KINDS, words=singles, meaning=materialise(meaning), entries=entries))
    town_hits = sql("SELECT c.* FROM {c} AS c LEFT SEMI JOIN {t} AS t ON c.entry = t.entry", c=close, t=towns)
    by_parts = sql(LAB_PARTS, towns=sql(LAB_TOWNS, words=words, close=town_hits), kinds=kinds, entries=entries)
    by_whole = sql(LAB_WHOLE, values=values, entries=entries, close=close)
    hits = sql("SELECT value, 1 AS way, lab_name AS entry FROM {a} UNION ALL SELECT value, 2 AS way, lab_name AS entry FROM {b}", a=by_parts, b=by_whole)
    return sql(REPORT, raw=raw, one=materialise(sql(ONE_ENTRY, hits=hits)))


def map_states(spark: SparkSession, raw: DataFrame, states: DataFrame, k: int = 2) -> DataFrame:
    """(value, canonical) for each distinct value of ``raw``; an empty string if it means no single state."""
    sql = spark.sql
    parts = materialise(sql(STATE_PARTS, raw=raw))
    names = sql(STATE_NAMES, states=states)
    close = materialise(pigeonhole(spark, sql("SELECT part AS word FROM {p}", p=parts), sql("SELECT entry FROM {n}", n=names), k))
    alias = "map(" + ",".join(f"'{a}','{b}'" for a, b in STATE_ALIASES.items()) + ")"
    hits = sql(STATE_HITS.replace("{alias}", alias), parts=parts, names=names, close=close)
    return sql(REPORT, raw=raw, one=materialise(sql(ONE_ENTRY, hits=hits)))


def canonical_values(df: DataFrame, labs: DataFrame, states: DataFrame, key: str = "id", lab: str = "testing_lab", state: str = "state") -> DataFrame:
    """(key, field, canonical): one row for each non-null value that isn't exactly an entry of its list.

    Values that mean no single entry, the empty string among them, have an
    empty ``canonical``. An empty list leaves every value without an entry;
    an empty table gives no rows.
    """
    spark = df.sparkSession
    out = []
    for field, ref, name, run in ((lab, labs, "lab_name", map_labs), (state, states, "state_name", map_states)):
        raw = spark.sql(f"SELECT t.`{key}` AS id, t.`{field}` AS value FROM {{t}} AS t LEFT ANTI JOIN {{r}} AS r ON t.`{field}` = r.`{name}` WHERE t.`{field}` IS NOT NULL", t=df, r=ref)
        distinct = materialise(spark.sql("SELECT DISTINCT value FROM {raw}", raw=raw))
        mapped = run(spark, distinct, ref)
        out.append(spark.sql(f"SELECT r.id AS `{key}`, '{field}' AS field, m.canonical FROM {{raw}} AS r JOIN {{mapped}} AS m ON r.value = m.value", raw=raw, mapped=mapped))
    return out[0].unionByName(out[1])
