"""Operator 4: benchmark decontamination by template canonicalisation. DataFrame functions only.

Numbers, names and units become typed placeholders, every other word its lower case. Windows of
eight such tokens of the documents meet those of the benchmark items by a hash join. Beside its
template a window has its literal form, all tokens in lower case, and meets equal ones by that too.
Matches of a document and an item on the same diagonal (equal distance of positions) belong
together. Literal windows always count. A window with changed slots counts if its slots are
consistent with the rest: each value of the item stands for one value of the document and the other
way round. Where values disagree, the pair at most positions wins (then the unchanged one, then the
first by value), and windows with another pair are left out; the others stay. So a
question whose numbers or names were changed is found, while texts that merely share a form are
not. A document is contaminated by an item if the windows that count cover at least half of its
tokens.

Items of fewer than eight tokens are one window of their own length; one or two tokens match only a
text that holds nothing else, an item without tokens matches nothing. Templates have at least four
tokens, half of them words: placeholders alone are no question. Number-heavy and short items are
found where they stand literally. A name is a capitalised word that is no function word, wherever
it stands. Signs of scripts without spaces are a token each.

Only windows that some item has leave the document's row, as long as the items have at most
``SET_WINDOWS`` windows: these are broadcast. With more, all windows are shuffled. Nothing of the
windows passes through the driver's program or stands in the plan.

Documents and items without text or id take no part. Documents that repeat an id count as one,
items with equal text as the one with the smallest id. Extra columns are ignored; empty tables
give an empty result. Ties between diagonals go to the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import stored, table

WINDOW = 8
SHORTEST_TEMPLATE = 4
SHORTEST_INSIDE = 3
MIN_SHARE = 0.5
SET_WINDOWS = 50_000

# Kana, Han, Thai, Lao, Burmese and Khmer are written without spaces.
_SOLO = r"\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3041}-\x{30ff}\x{3400}-\x{9fff}\x{20000}-\x{323af}"
_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
# Possessive, as Java would otherwise need stack for every group of digits.
_TOKEN = rf"{_NUMBER}+|[{_SOLO}]\p{{M}}*|[\p{{L}}&&[^{_SOLO}]][\p{{L}}\p{{M}}&&[^{_SOLO}]]*|[%$€£]"
_TOKEN_SQL = rf"{_NUMBER}|[{_SOLO}]\p{{M}}*|[^\P{{L}}{_SOLO}](?:[^\P{{L}}{_SOLO}]|[^\P{{M}}{_SOLO}])*|[%$€£]"
UNITS = (
    "%", "$", "€", "£", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "pound",
    "pounds", "mm", "cm", "m", "km", "metre", "metres", "meter", "meters", "kilometre",
    "kilometres", "kilometer", "kilometers", "inch", "inches", "foot", "feet", "yard", "yards",
    "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces",
    "ml", "l", "litre", "litres", "liter", "liters", "second", "seconds", "minute", "minutes",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph",
    "kmh", "degrees", "celsius", "fahrenheit", "joule", "joules", "watt", "watts", "volt", "volts",
)
NUMBER_WORDS = (
    "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred",
    "thousand", "million", "billion",
)

# Capitalised at the beginning of a sentence, and still no names.
FUNCTION_WORDS = (
    "a", "about", "after", "all", "also", "although", "among", "an", "and", "any", "are", "as", "at", "because",
    "before", "between", "both", "but", "by", "can", "compute", "could", "did", "do", "does", "during", "each", "either",
    "every", "find", "for", "from", "given", "had", "has", "have", "he", "her", "here", "his", "how", "if", "in", "into",
    "is", "it", "its", "let", "many", "may", "more", "most", "must", "my", "no", "not", "of", "on", "one", "or", "our",
    "over", "she", "should", "since", "so", "some", "such", "suppose", "than", "that", "the", "their", "then", "there",
    "these", "they", "this", "those", "through", "to", "under", "until", "was", "we", "were", "what", "when", "where",
    "which", "while", "who", "whom", "whose", "why", "will", "with", "would", "you", "your",
    "aber", "auf", "aus", "das", "dem", "den", "der", "die", "ein", "eine", "er", "es", "ist", "mit", "sie", "und",
    "von", "wann", "warum", "was", "welche", "welcher", "welches", "wenn", "wer", "wie", "wir", "wo", "zu",
    "au", "aux", "avec", "ce", "cette", "combien", "comment", "dans", "des", "du", "elle", "est", "et", "il", "la",
    "le", "les", "pour", "pourquoi", "quand", "que", "quel", "quelle", "qui", "si", "un", "une",
    "como", "con", "cual", "cuando", "donde", "el", "ella", "en", "los", "las", "para", "por", "una", "y",
)


def templates(text: Column) -> Column:
    """Array of (c, v): the canonical form of each token, and its lower case."""

    def form(token: Column, low: Column) -> Column:
        rest = F.substring(token, F.lit(2), F.length(token))
        name = (
            (low != token) & (F.length(token) > 1) & (rest == F.lower(rest)) & ~low.isin(*FUNCTION_WORDS)
        )
        canonical = (
            F.when((token >= "0") & (token < ":"), "#n").when(low.isin(*NUMBER_WORDS), "#n")
            .when(low.isin(*UNITS), "#u").when(name, "#p").otherwise(low)
        )
        return F.struct(canonical.alias("c"), low.alias("v"))

    found = F.regexp_extract_all(text, F.lit(_TOKEN), 0)
    return F.transform(
        F.transform(found, lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"))),
        lambda p: form(p.getField("t"), p.getField("low")),
    )


def _token_hashes(tokens: Column, kind: str) -> Column:
    """Tokens occur in many windows; each is hashed once."""
    return F.transform(tokens, lambda p: F.xxhash64(p.getField(kind)))


def _hash(hashes: Column, place: Column, size: int, kind: str) -> Column:
    return F.xxhash64(F.lit(f"{kind}{size}"), *[F.get(hashes, place + k) for k in range(size)])


def _places(tokens: Column, size: int) -> Column:
    """Where a window can begin; a very short one has to be the whole text."""
    last = F.size(tokens) - size
    fits = last >= 0 if size >= SHORTEST_INSIDE else last == 0
    return F.when(fits, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item_words, size, ipos, iwin, kind, h) of the benchmark; kind c is the template, v literal."""
    unique = (
        items.filter(F.col(id_column).isNotNull() & F.col(text).isNotNull())
        .groupBy(F.col(text).alias("t")).agg(F.min(id_column).alias("item_id"))
        .select("item_id", templates(F.col("t")).alias("tokens"))
    )
    unique = unique.withColumn("item_words", F.size("tokens")).filter("item_words > 0")
    words = F.size(F.filter("iwin", lambda p: ~p.getField("c").startswith("#")))
    found = None
    for size in range(1, WINDOW + 1):
        some = unique.filter(
            F.col("item_words") >= size if size == WINDOW else F.col("item_words") == size
        )
        kinds = [
            F.struct(
                F.lit(kind).alias("kind"), _hash(_token_hashes(F.col("iwin"), kind), F.lit(0), size, kind).alias("h")
            )
            for kind in ("c", "v")
        ]
        rows = some.select(
            "item_id", "item_words", F.lit(size).alias("size"), "tokens",
            F.explode(_places(F.col("tokens"), size)).alias("ipos"),
        ).withColumn("iwin", F.slice("tokens", F.col("ipos") + 1, size)).select(
            "item_id", "item_words", "size", "ipos", "iwin", F.inline(F.array(*kinds)),
        )
        found = rows if found is None else found.union(rows)
    template = (2 * words >= F.col("size")) & (F.col("size") >= SHORTEST_TEMPLATE)
    return found.filter((F.col("kind") == "v") | template)


def document_windows(
    documents: DataFrame, sizes: list[int], wanted: DataFrame | None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, dpos, dwin, h) of the windows, by template and by literal form, whose ``h`` is ``wanted`` (None: of all)."""
    rows = documents.filter(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(
        id_column, templates(F.col(text)).alias("tokens")
    )
    hashed = rows.select(id_column, "tokens", *[_token_hashes(F.col("tokens"), kind).alias(kind) for kind in ("c", "v")])

    def some(size: int, kind: str) -> Column:
        return F.transform(_places(F.col("tokens"), size), lambda i: F.struct(
            i.alias("dpos"), F.lit(size).alias("size"), _hash(F.col(kind), i, size, kind).alias("h")
        ))

    every = F.concat(*[some(size, kind) for size in sizes for kind in ("c", "v")])
    # Outer, as an inner explode would make the optimizer compute the array a second time for a filter.
    found = (
        hashed.select(id_column, "tokens", every.alias("windows"))
        .select(id_column, "tokens", F.explode_outer("windows").alias("w")).filter(F.col("w").isNotNull())
        .select(id_column, "tokens", "w.*")
    )
    if wanted is not None:
        # By the hash alone, so that the join is compiled and copies the tokens only of windows it meets.
        found = found.join(F.broadcast(wanted.select("h")), "h", "left_semi")
    return found.select(id_column, "dpos", F.slice("tokens", F.col("dpos") + 1, F.col("size")).alias("dwin"), "h")


def contaminated(documents: DataFrame, items: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, item_id, item_words, covered, changed): documents that hold a benchmark item.

    ``covered`` tokens of the item are matched, ``changed`` slot values differ from the item's.
    """
    windows = stored(item_windows(items))
    counts = windows.groupBy("size", "kind").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = sorted({r["size"] for r in counts}) or [WINDOW]
    few = sum(r["n"] for r in counts) <= 2 * SET_WINDOWS
    found = document_windows(documents, sizes, windows if few else None, id_column)
    # The hash tells size and kind apart; the tokens are compared below.
    matched = found.join(F.broadcast(windows) if few else windows, "h")

    def values(window: str, field: str) -> Column:
        return F.transform(window, lambda p: p.getField(field))

    literal = values("iwin", "v") == values("dwin", "v")
    equal = F.when(F.col("kind") == "v", literal).otherwise(values("iwin", "c") == values("dwin", "c"))
    zipped = F.arrays_zip(F.col("iwin").alias("i"), F.col("dwin").alias("d"))
    slots = F.transform(zipped, lambda z, k: F.struct(
        (F.col("ipos") + k).alias("place"), z.getField("i").getField("c").alias("c"),
        z.getField("i").getField("v").alias("iv"), z.getField("d").getField("v").alias("dv"),
    ))
    keys = [id_column, "item_id", "item_words", "diagonal"]
    rows = (
        matched.filter(equal).select(
            id_column, "item_id", "item_words", (F.col("dpos") - F.col("ipos")).alias("diagonal"), "ipos",
            literal.alias("literal"), slots.alias("slots"),
        )
        # One shuffle: everything below is per diagonal, which has no more windows than its item.
        .repartition(*keys).distinct()
    )
    flat = rows.select(*keys, "ipos", "literal", F.inline("slots")).withColumn(
        "votes", F.size(F.collect_set("place").over(Window.partitionBy(*keys, "c", "iv", "dv")))
    )

    def best(of: str, by: str) -> Column:
        order = [F.desc("votes"), F.desc(F.col("iv") == F.col("dv")), F.asc(of)]
        return F.first(of).over(Window.partitionBy(*keys, "c", by).orderBy(*order))

    agreed = (best("dv", "iv") == F.col("dv")) & (best("iv", "dv") == F.col("iv"))
    slot = F.col("c").startswith("#")
    sound = F.min(~slot | F.col("agreed")).over(Window.partitionBy(*keys, "ipos"))
    kept = flat.withColumn("agreed", agreed).withColumn("sound", sound).filter(F.col("literal") | F.col("sound"))
    grouped = kept.groupBy(*keys).agg(
        F.size(F.collect_set("place")).alias("covered"),
        F.size(F.collect_set(F.when(slot & (F.col("iv") != F.col("dv")), F.struct("c", "iv", "dv")))).alias("changed"),
    )
    most = F.max_by(F.struct("covered", "changed"), F.struct("covered", -F.col("diagonal")))
    return (
        grouped.filter(F.col("covered") >= MIN_SHARE * F.col("item_words")).groupBy(*keys[:3])
        .agg(most.alias("b")).select(*keys[:3], "b.covered", "b.changed")
    )


def clean(documents: DataFrame, items: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents that hold no benchmark item; those without an id stay."""
    found = contaminated(documents, items, id_column).select(id_column).distinct()
    return documents.join(stored(found), id_column, "left_anti").select(documents.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _sql_tokens(source: str, key: str) -> str:
    """SQL for one row per token: (key, pos, c, v)."""
    return f"""
    SELECT {key}, place - 1 AS pos, lower(t) AS v,
        CASE WHEN t >= '0' AND t < ':' THEN '#n' WHEN lower(t) IN ({_sql_list(NUMBER_WORDS)}) THEN '#n'
             WHEN lower(t) IN ({_sql_list(UNITS)}) THEN '#u'
             WHEN lower(t) <> t AND length(t) > 1 AND substr(t, 2) = lower(substr(t, 2))
                  AND lower(t) NOT IN ({_sql_list(FUNCTION_WORDS)}) THEN '#p'
             ELSE lower(t) END AS c
    FROM (SELECT {key}, unnest(l) AS t, generate_subscripts(l, 1) AS place
          FROM (SELECT {key}, regexp_extract_all(text, '{_TOKEN_SQL}') AS l FROM {source}))"""


def _sql_windows(tokens: str, key: str) -> str:
    """SQL for all windows of all sizes: (key, size, pos, cs, vs)."""
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT {key}, {size} AS size, pos,
            list(c) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS cs,
            list(v) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS vs
            FROM {tokens}) WHERE len(cs) = {size}"""
        for size in range(1, WINDOW + 1)
    )


_KEYS = "doc_id, item_id, item_words, diagonal"
ORACLE_SQL = f"""
WITH items AS (SELECT min(item_id) AS item_id, text FROM benchmark
               WHERE text IS NOT NULL AND item_id IS NOT NULL GROUP BY text),
docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
it AS ({_sql_tokens('items', 'item_id')}),
dt AS ({_sql_tokens('docs', 'doc_id')}),
n AS (SELECT item_id, count(*) AS item_words FROM it GROUP BY item_id),
dn AS (SELECT doc_id, count(*) AS doc_words FROM dt GROUP BY doc_id),
iw AS (SELECT w.*, n.item_words, size >= {SHORTEST_TEMPLATE}
              AND 2 * len(list_filter(cs, lambda x: NOT starts_with(x, '#'))) >= size AS template
       FROM ({_sql_windows('it', 'item_id')}) w JOIN n USING (item_id)
       WHERE CASE WHEN item_words >= {WINDOW} THEN size = {WINDOW} ELSE size = item_words END),
dw AS (SELECT w.* FROM ({_sql_windows('dt', 'doc_id')}) w JOIN dn USING (doc_id)
       WHERE size >= {SHORTEST_INSIDE} OR size = doc_words),
m AS (SELECT dw.doc_id, iw.item_id, iw.item_words, dw.pos - iw.pos AS diagonal, iw.pos AS ipos,
             iw.size, iw.cs, iw.vs AS ivs, dw.vs AS dvs
      FROM dw JOIN iw ON dw.size = iw.size AND dw.cs = iw.cs AND iw.template
      UNION
      SELECT dw.doc_id, iw.item_id, iw.item_words, dw.pos - iw.pos AS diagonal, iw.pos AS ipos,
             iw.size, iw.cs, iw.vs AS ivs, dw.vs AS dvs
      FROM dw JOIN iw ON dw.size = iw.size AND dw.vs = iw.vs),
x AS (SELECT {_KEYS}, ipos, literal, ipos + k - 1 AS place, cs[k] AS c, ivs[k] AS iv, dvs[k] AS dv
      FROM (SELECT *, ivs = dvs AS literal, unnest(range(1, size + 1)) AS k FROM m)),
v AS (SELECT *, count(DISTINCT place) OVER (PARTITION BY {_KEYS}, c, iv, dv) AS votes FROM x),
a AS (SELECT *, dv = first_value(dv) OVER (PARTITION BY {_KEYS}, c, iv ORDER BY votes DESC, (iv = dv) DESC, dv)
            AND iv = first_value(iv) OVER (PARTITION BY {_KEYS}, c, dv ORDER BY votes DESC, (iv = dv) DESC, iv) AS agreed
      FROM v),
k AS (SELECT *, min(CAST(agreed OR NOT starts_with(c, '#') AS INTEGER)) OVER (PARTITION BY {_KEYS}, ipos) AS sound
      FROM a),
g AS (SELECT {_KEYS}, count(DISTINCT place) AS covered,
             count(DISTINCT CASE WHEN starts_with(c, '#') AND iv <> dv THEN (c, iv, dv) END) AS changed
      FROM k WHERE literal OR sound = 1 GROUP BY {_KEYS}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY covered DESC, diagonal) AS o
      FROM g WHERE covered >= {MIN_SHARE} * item_words)
SELECT doc_id, item_id, CAST(item_words AS INTEGER) AS item_words, CAST(covered AS INTEGER) AS covered,
       CAST(changed AS INTEGER) AS changed FROM r WHERE o = 1
"""
