"""Operator 12: personal data by gradient-boosted candidates. DataFrame functions only.

Base spans are the matches of a fixed pattern per kind that pass the kind's check (parts of an
address, number of digits, Luhn). They are always redacted. Beside them, looser generators propose
spans with high recall: numbers without a country code, disguised mail addresses, disguised and
IPv6 addresses, card numbers with unusual separators. Their spans may overlap. Boosted trees judge
each by its format and by the words around it, and a threshold per kind, calibrated on findings
that the trees have not seen, selects redactions. Trees and thresholds are learned from findings
that are made here from invented values in four languages.

Proposals that overlap a base span are dropped. Selected proposals that overlap each other become
one redaction, from the first start to the last end, under the kind of the best score: no selected
character is lost. Offsets count code points and ends are exclusive.

Patterns run in linear time, whatever the text: runs are possessive and begin where a run begins.
A text is cut at the matches of a pattern once. Null texts count as empty; the same text under the
same id is scanned once, and every row, also a repeated one or one without an id, has its result.
Ties between kinds go by their order in ``KINDS``. A score equal to the threshold is selected. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")
# Findings that are made, the share kept for the thresholds, and the size of the trees.
EXAMPLES, CALIBRATION, ROUNDS, DEPTH = 8_000, 0.3, 12, 4
# Precision that a kind's threshold must reach on the findings kept for it.
PRECISION = 0.99
_BEFORE, _AFTER = 40, 16

_LOCAL = r"[A-Za-z0-9._%+\-]"
_LABEL = r"[A-Za-z0-9\-]++"
# A run begins where the last match ended or where no character of the run stands before.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
_AT = r"(?:\x20?[(\[{]\x20?(?:at|@)\x20?[)\]}]\x20?|\x20at\x20|\x20@\x20)"
_DOT = r"(?:\x20?[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20?|\x20dot\x20|\.)"
_DOTTED = r"(?:\x20?[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20?|\x20dot\x20)"
_OCTET = r"[0-9]{1,3}"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_LABEL}(?:{_DOT}{_LABEL})++",
    "ip": (
        rf"(?<![0-9A-Za-z.:])(?:{_OCTET}{_DOTTED}{_OCTET}{_DOTTED}{_OCTET}{_DOTTED}{_OCTET}(?![0-9A-Za-z])"
        r"|(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:]))"
    ),
    "card": r"(?<![0-9A-Za-z.+])[0-9](?:[\x20.\-/]{0,2}[0-9]){11,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+])\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,14}(?![0-9A-Za-z])",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|write|contact|correo|courriel|adresse|inbox|schreib)",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|ping|ssh|dns|gateway|peer|address|addr|node|servidor|serveur)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|payment|pay|charge|kredit)",
    "phone": r"(?i)\b(?:phone|telephone|tel|call|mobile|cell|fax|dial|sms|telefon|tel[eé]fono|t[eé]l|handy|llam|m[oó]vil|appel|ruf)",
    "other": r"(?i)\b(?:order|invoice|isbn|issn|doi|version|build|release|id|serial|page|section|sku|ref|ticket|case"
             r"|date|year|total|price|score|commit|hash|checksum|tracking|account|population|bytes|lines|pedido|commande|bestellung|rechnung|factura)\b",
}
FEATURES = (
    *(f"is_{kind}" for kind in KINDS), "length", "digits", "letters", "spaces", "dots", "dashes", "slashes",
    "brackets", "colons", "groups", "longest", "first_group", "last_group", "distinct", "leading_zero", "area_code",
    "luhn", "major", "like_date", "like_year", "at_word", "dot_word", "short_ending", "hex_letters", "two_colons",
    *(f"{name}_before" for name in _WORDS), *(f"{name}_near" for name in _WORDS), "money", "unit_after",
    "colon_before", "number_before", "number_after", "upper_before",
)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a valid check digit. False for an empty text."""
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 1, F.element_at(
            F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1
        )).otherwise(d.cast("int"))),
        F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def passes(kind: str, value: Column) -> Column:
    """The check of a base match."""
    digits = digits_of(value)
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        # The check digit is only worked out for numbers of the right length.
        "card": F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def _cut(text: Column, kind: str, base: bool) -> Column:
    """Array of the matches of a pattern with what stands around them; empty if there are none."""
    pattern = (BASE if base else LOOSE)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern)

    def one(gaps: Column) -> Column:
        return F.transform(found, lambda c, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("place"), c.alias("c"),
            F.length(F.get(gaps, i)).cast("long").alias("gap"),
            F.right(F.get(gaps, i), F.lit(_BEFORE)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(_AFTER)).alias("after"),
        ))

    # The second pass over the text, and its single evaluation, only where there are matches.
    return F.when(F.size(found) > 0, F.element_at(F.transform(F.array(gaps), one), 1))


def candidates(rows: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, kind, base, c, start, end, before, after): all matches of all patterns.

    Base matches have passed their kind's check.
    """
    whole = rows.select(
        F.col(id_column).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        F.col(text).alias("text"),
    ).filter(F.col("text").rlike(r"[0-9@]|[ (\[{]at[ )\]}]|[A-Fa-f]:"))
    lists = [_cut(F.col("text"), kind, base) for base in (True, False) for kind in KINDS]
    exploded = whole.select("id", "text_hash", F.array(*lists).alias("lists")).select(
        "id", "text_hash", F.explode(F.flatten(F.filter("lists", lambda x: x.isNotNull()))).alias("x")
    ).select("id", "text_hash", "x.*")
    unique = exploded.dropDuplicates(["id", "text_hash", "kind", "base", "place"])
    own = Window.partitionBy("id", "text_hash", "kind", "base").orderBy("place")
    end = F.sum(F.col("gap") + F.length("c")).over(own)
    sound = functools.reduce(lambda a, b: a | b, [
        (F.col("kind") == kind) & passes(kind, F.col("c")) for kind in KINDS
    ])
    placed = unique.withColumn("end", end).withColumn("start", F.col("end") - F.length("c"))
    return placed.filter(~F.col("base") | sound).select(
        "id", "text_hash", "kind", "base", "c", "start", "end", "before", "after"
    )


def proposals(found: DataFrame) -> DataFrame:
    """Base spans, and the proposals that overlap none of them."""
    own = Window.partitionBy("id", "text_hash")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(own.orderBy("start", F.desc("base")))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(own.orderBy(F.desc("start"), F.desc("base")))
    near = found.withColumns({"base_before": before, "base_after": after})
    free = (F.coalesce("base_before", F.lit(0)) <= F.col("start")) & (
        F.col("base_after").isNull() | (F.col("base_after") >= F.col("end"))
    )
    return near.filter(F.col("base") | free).drop("base_before", "base_after")


def _count(value: Column, pattern: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))


def with_features(rows: DataFrame) -> DataFrame:
    """The features of the columns kind, c, before and after."""
    c, before, after = F.col("c"), F.col("before"), F.col("after")
    digits = digits_of(c)
    groups = F.regexp_extract_all(c, F.lit("[0-9]+"), 0)
    near = F.concat_ws(" ", before, after)
    last = F.right(before, F.lit(16))
    features = {
        **{f"is_{kind}": F.col("kind") == kind for kind in KINDS},
        "length": F.length(c), "digits": F.length(digits), "letters": _count(c, "[A-Za-z]"),
        "spaces": _count(c, " "), "dots": _count(c, r"\."), "dashes": _count(c, "-"), "slashes": _count(c, "/"),
        "brackets": _count(c, r"[()\[\]{}]"), "colons": _count(c, ":"), "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "first_group": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
        "last_group": F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "leading_zero": digits.startswith("0"), "area_code": c.rlike(r"^\([0-9]{2,5}\)"),
        "luhn": luhn(digits), "major": digits.rlike("^[3-6]"),
        "like_date": c.rlike(r"(?:19|20)[0-9]{2}[./\- ][01]?[0-9][./\- ][0-3]?[0-9]|[0-3]?[0-9][./\-][01]?[0-9][./\-](?:19|20)[0-9]{2}"),
        "like_year": c.rlike(r"^(?:19|20)[0-9]{2}(?![0-9])"), "at_word": c.rlike(r"[ (\[{]at[ )\]}]"),
        "dot_word": c.rlike(r"[ (\[{]dot[ )\]}]"), "short_ending": c.rlike(r"[. )\]}][a-z]{2,4}$"),
        "hex_letters": _count(c, "[A-Fa-f]"), "two_colons": c.contains("::"),
        **{f"{name}_before": last.rlike(words) for name, words in _WORDS.items()},
        **{f"{name}_near": near.rlike(words) for name, words in _WORDS.items()},
        "money": before.rlike(r"[$€£]\s?$") | after.rlike(r"^\s?(?:[$€£]|eur|usd)"),
        "unit_after": after.rlike(r"(?i)^\s?(?:%|kg|km|m\b|cm|ms|s\b|bytes|kb|mb|gb|pages|people|units|inhabitants|hours)"),
        "colon_before": before.rlike(r"[:=#]\s?[\"']?$"), "number_before": before.rlike(r"[0-9][\s,.;]{0,2}$"),
        "number_after": after.rlike(r"^[\s,.;]{0,2}[0-9]"), "upper_before": before.rlike(r"[A-Z]{2,}[\s\-]?$"),
    }
    return rows.select("*", *[features[name].cast("double").alias(name) for name in FEATURES])


def labelled_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(kind, c, before, after, label): made findings of known kind, as the generators propose them."""
    made = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 512)
    rows = spark.range(0, n, 1, 4).withColumns({
        "d": F.regexp_replace(F.translate(made, "abcdef", "274916"), "^0", "3"), "hex": made,
    })

    def pick(salt: int, values: list[str]) -> Column:
        place = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1
        return F.element_at(F.array(*map(F.lit, values)), place.cast("int"))

    def shaped(shape: str, start: int = 1) -> Column:
        """Every 9 of ``shape`` is a made digit."""
        parts, at, run = [], start, 0
        for mark in shape + "\0":
            if mark == "9":
                run += 1
                continue
            if run:
                parts.append(F.substring("d", at, run))
                at, run = at + run, 0
            if mark != "\0":
                parts.append(F.lit(mark))
        return F.concat(*parts)

    def any_of(salt: int, *values: Column) -> Column:
        place = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))).cast("int") + 1
        return F.element_at(F.array(*values), place)

    def checked(head: Column, valid: bool) -> Column:
        """``head`` with a check digit, or with one that is wrong."""
        options = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(head, i.cast("string")))
        right = F.filter(options, luhn)
        return F.element_at(right if valid else F.array_except(options, right), 1)

    def grouped(digits: Column, mark: Column) -> Column:
        return F.concat_ws("", F.substring(digits, 1, 4), mark, F.substring(digits, 5, 4), mark,
                           F.substring(digits, 9, 4), mark, F.substring(digits, 13, 4))

    words = ["the", "river", "garden", "market", "casa", "maison", "haus", "winter", "people", "story", "blue",
             "nombre", "jour", "zeit", "city", "letter", "paper", "silver", "camino", "arbre", "stein", "north"]
    rows = rows.withColumns({f"word{k}": pick(20 + k, words) for k in range(4)})
    word = [F.col(f"word{k}") for k in range(4)]
    prose = F.col("prose")
    say = {
        "phone": ["call ", "phone: ", "tel. ", "my mobile is ", "fax ", "Tel: ", "reach us on ", "telefon ", "ruf an unter ",
                  "llame al ", "appelez le ", "dial ", "number is ", "text me at ", "Handy ", "hotline "],
        "email": ["mail me at ", "contact: ", "email ", "write to ", "correo ", "courriel : ", "ask ", "reach ", "Mail: ",
                  "by mail "],
        "ip": ["host ", "server ", "from ip ", "ping ", "IP: ", "ssh to ", "node ", "address ", "login from ", "seen at "],
        "card": ["card ", "visa ", "my credit card: ", "paid with ", "Karte ", "tarjeta ", "carte ", "card no. ",
                 "charge it to ", "debit "],
        "other": ["order ", "invoice no. ", "ISBN ", "version ", "build ", "serial ", "id ", "ref ", "tracking ", "total ",
                  "page ", "since ", "score ", "case ", "Bestellung ", "pedido ", "commande ", "population ", "$", "account "],
    }

    rows = rows.withColumns({
        "prose": F.concat_ws(" ", word[0], word[1], F.lit("")), "mark": pick(49, ["-", ".", "/"]),
        "fourteen": F.concat(pick(41, ["4", "5", "3", "6"]), F.substring("d", 2, 14)),
        "local": any_of(4, F.concat_ws(".", word[0], word[2]), word[0], F.concat(word[0], shaped("99")),
                        F.concat_ws("_", word[0], word[2])),
        "host": any_of(5, word[3], F.concat_ws("-", word[3], word[1]), F.concat(word[3], word[1]),
                       F.concat(word[3], shaped("9"))),
        "at": pick(42, [" (at) ", "[at]", " [at] ", "(at)", " at ", "{at}"]),
        "dot": pick(43, [" (dot) ", "[dot]", " dot ", "(.)"]),
        "ending": pick(44, ["com", "org", "net", "de", "fr", "es", "edu", "io"]),
        "fang": pick(45, ["[.]", "(.)", " dot ", "[dot]"]), "wide": pick(57, [".", "/", "  ", " - ", "--"]),
        "national": any_of(1, shaped("(999) 999-9999"), shaped("999-999-9999"), shaped("999.999.9999"),
                           shaped("0999 9999999"), shaped("099 99 99 99 99"), shaped("(0999) 999999"),
                           shaped("0099 999 9999999"), shaped("0999/999999")),
    })
    national, fang, wide = F.col("national"), F.col("fang"), F.col("wide")
    local, host, at, dot, ending = (F.col(name) for name in ("local", "host", "at", "dot", "ending"))
    octets = F.concat_ws("", *[part for k in range(4) for part in (
        F.pmod(F.xxhash64("id", F.lit(60 + k)), F.lit(256)).cast("string"), fang)][:7])
    colon = F.concat_ws(":", *[F.ltrim(F.substring("hex", 1 + 4 * k, 4), F.lit("0")) for k in range(8)])
    short = F.concat_ws(":", F.lit("fe80:"), *[F.substring("hex", 1 + 4 * k, 4) for k in range(4)])
    clock = F.concat_ws(":", pick(46, ["09", "12", "23", "7"]), pick(47, ["05", "30", "59"]), pick(48, ["00", "15", "48"]))
    day = F.concat(pick(50, ["2019", "2024", "1998", "2011"]), F.col("mark"), pick(51, ["01", "07", "12"]),
                   F.col("mark"), pick(52, ["03", "17", "28"]))
    rows = rows.withColumns({
        **{f"say_{kind}": F.concat(prose, pick(40, values)) for kind, values in say.items()},
        "valid": checked(F.col("fourteen"), True), "invalid": checked(F.col("fourteen"), False),
        "thirteen": checked(F.concat(F.lit("4"), F.substring("d", 2, 11)), True),
        "octets": octets, "colon": colon, "short": short, "clock": clock, "day": day,
        "beside": F.concat(prose, shaped("9999", 40), F.lit(" ")),
        "numbers": any_of(2, shaped("99999999"), shaped("9999999999"), shaped("999999999999"), shaped("9 999 999"),
                          shaped("99.999.999"), shaped("999999-99"), shaped("9999-9999"), shaped("99 99 9999")),
    })
    octets, colon, short, clock, day, valid, invalid, numbers, after_number = (F.col(name) for name in (
        "octets", "colon", "short", "clock", "day", "valid", "invalid", "numbers", "beside"))

    def said(kind: str) -> Column:
        return F.col(f"say_{kind}")

    ranges = any_of(3, shaped("978-9-99-999999-9"), F.concat(day, F.lit(" "), shaped("99")), day,
                    F.concat(pick(53, ["1990", "2001"]), F.lit("-"), pick(54, ["1995", "2023"])), shaped("9.9999999"))
    kinds: list[tuple[float, str, Column, Column]] = [
        (1, "phone", national, said("phone")), (1, "phone", national, said("phone")), (1, "phone", national, prose),
        (1, "phone", shaped("999-9999"), said("phone")),
        (0, "phone", numbers, said("other")), (0, "phone", numbers, prose), (0, "phone", ranges, said("other")),
        (0, "phone", ranges, prose), (0, "phone", shaped("9999999999999"), prose), (0, "phone", numbers, said("ip")),
        (1, "email", F.concat(local, at, host, dot, ending), said("email")),
        (1, "email", F.concat(local, at, host, dot, ending), prose),
        (1, "email", F.concat(local, pick(55, ["(at)", "[at]", " [at] "]), host, F.lit("."), ending), said("email")),
        (0, "email", F.concat(word[0], F.lit(" at "), word[1], F.lit(" dot "), word[2]), prose),
        (0, "email", F.concat(word[0], F.lit(" at "), word[1], F.lit("."), word[2]), prose),
        (0, "email", F.concat(word[0], F.lit(" @ "), shaped("9.99")), said("other")),
        (1, "ip", octets, said("ip")),
        (1, "ip", octets, prose),
        (1, "ip", colon, said("ip")), (1, "ip", colon, prose), (1, "ip", short, prose),
        (0, "ip", clock, prose), (0, "ip", clock, said("other")),
        (0, "ip", F.concat_ws(":", *[F.substring("hex", 1 + 2 * k, 2) for k in range(6)]), prose),
        (0, "ip", F.concat_ws(" dot ", *[pick(56 + k, ["1", "2", "3"]) for k in range(4)]), said("other")),
        (1, "card", grouped(valid, wide), said("card")),
        (1, "card", grouped(valid, wide), prose),
        (1, "card", F.col("thirteen"), said("card")),
        # Two numbers side by side, which the base pattern takes for one that is too long.
        (1, "card", valid, F.concat(prose, shaped("9999999999999999", 40), F.lit(" "))),
        (1, "card", valid, after_number),
        (1, "card", valid, prose),
        (1, "phone", F.concat(F.lit("+"), national), F.concat(prose, shaped("999", 40), F.lit(" "))),
        (0, "card", invalid, after_number),
        (0, "card", invalid, prose), (0, "card", invalid, said("other")),
        (0, "card", shaped("9999999999999"), said("other")), (0, "card", shaped("9999 9999 9999"), prose),
        (0, "card", grouped(invalid, wide), said("other")),
        (0, "card", F.concat(day, F.lit(" "), shaped("99999")), prose),
    ]
    place = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(len(kinds)))
    beside = next(i for i, kind in enumerate(kinds) if kind[:2] == (1, "card") and kind[3] is prose and kind[2] is valid)

    def chosen(part: int) -> Column:
        values = [F.lit(kind[part]) if part < 2 else kind[part] for kind in kinds]
        return functools.reduce(
            lambda found, i: found.when(place == i, values[i]), range(1, len(kinds)), F.when(place == 0, values[0])
        )

    return rows.select(
        chosen(1).alias("kind"), chosen(2).alias("c"), F.right(chosen(3), F.lit(_BEFORE)).alias("before"),
        # A valid number that the base pattern did not take has another number beside it.
        F.concat(pick(58, [" ", ". ", ", ", " and ", "; "]), F.when(
            (place == beside) | (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(12)) == 0), shaped("99999", 60)
        ).otherwise(word[3])).alias("after"),
        chosen(0).cast("double").alias("label"), F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1000)).alias("fold"),
    ).filter(F.col("c").isNotNull())


@dataclass(frozen=True)
class Judge:
    """Boosted trees and the least score of a redaction of each kind."""

    trees: Model
    thresholds: dict[str, float]


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(rows))


def scored(found: DataFrame, trees: Model) -> DataFrame:
    """Candidates with the probability that the trees give them, as ``score``."""
    judged = trees.transform(_assembled(found))
    return judged.withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction", *FEATURES
    )


def least_score(pairs: list[tuple[float, float]], precision: float = PRECISION) -> float:
    """The smallest score from which on at least ``precision`` of the labels are 1.

    Equal scores stand or fall together. 1.0 and more selects nothing, if no score will do.
    """
    best, right, seen = 1.0 + 1e-9, 0.0, 0
    ordered = sorted(pairs, reverse=True)
    for i, (score, label) in enumerate(ordered):
        right, seen = right + label, seen + 1
        last = i + 1 == len(ordered) or ordered[i + 1][0] < score
        if last and right >= precision * seen:
            best = score
    return best


def train(spark: SparkSession, n: int = EXAMPLES) -> Judge:
    """Trees and thresholds from ``n`` made findings; the driver sees the calibration's scores only."""
    data = stored(labelled_findings(spark, n).coalesce(2))
    kept = F.col("fold") < int(1000 * CALIBRATION)
    boosted = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=12, maxBins=32, cacheNodeIds=False)
    trees = boosted.fit(_assembled(data.filter(~kept)).select("features", "label"))
    rows = scored(data.filter(kept), trees).select("kind", "score", "label").collect()
    return Judge(trees, {
        kind: max(0.5, least_score([(r.score, r.label) for r in rows if r.kind == kind])) for kind in KINDS
    })


def personal_spans(rows: DataFrame, judge: Judge | None = None, id_column: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(id, text_hash, kind, start, end, base, score): what is to be redacted. Base spans score 1."""
    judge = judge or train(rows.sparkSession)
    found = stored(proposals(candidates(rows, id_column, text)))
    least = functools.reduce(
        lambda made, kind: made.when(F.col("kind") == kind, judge.thresholds[kind]), KINDS[1:],
        F.when(F.col("kind") == KINDS[0], judge.thresholds[KINDS[0]]),
    )
    chosen = scored(found.filter(~F.col("base")), judge.trees).filter(F.col("score") >= least)
    order = Window.partitionBy("id", "text_hash").orderBy("start", "end", "kind")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached.isNull() | (F.col("start") >= reached), 1).otherwise(0)
    chosen = chosen.withColumn("begins", begins).withColumn("island", F.sum("begins").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ))
    rank = functools.reduce(
        lambda made, i: made.when(F.col("kind") == KINDS[i], -i), range(1, len(KINDS)),
        F.when(F.col("kind") == KINDS[0], 0),
    )
    added = chosen.groupBy("id", "text_hash", "island").agg(
        F.max_by("kind", F.struct("score", rank)).alias("kind"), F.min("start").alias("start"),
        F.max("end").alias("end"), F.max("score").alias("score"),
    )
    columns = ["id", "text_hash", "kind", "start", "end"]
    return found.filter("base").select(*columns, F.lit(True).alias("base"), F.lit(1.0).alias("score")).unionByName(
        added.select(*columns, F.lit(False).alias("base"), "score")
    ).withColumnRenamed("id", id_column)


def _beside(rows: DataFrame, grouped: DataFrame, id_column: str, text: str) -> DataFrame:
    """``rows`` with the columns of ``grouped`` (id, text_hash, ...) of the same id and text."""
    named = grouped.withColumnsRenamed({id_column: "_pii_id", "text_hash": "_pii_hash"})
    hashed = rows.withColumn("_pii_own", F.xxhash64(F.coalesce(text, F.lit(""))))
    same = F.col(id_column).eqNullSafe(F.col("_pii_id")) & (F.col("_pii_own") == F.col("_pii_hash"))
    return hashed.join(named, same, "left").drop("_pii_id", "_pii_hash", "_pii_own")


def redact(rows: DataFrame, judge: Judge | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with [EMAIL], [IP], [CARD] or [PHONE] in place of personal data.

    Spans that overlap are one mark, of the kind that begins first. Other columns stay as they are.
    """
    found = personal_spans(rows, judge, id_column, text)
    order = Window.partitionBy(id_column, "text_hash").orderBy("start", F.desc("end"), "kind")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = found.withColumn("reached", reached).withColumn("island", F.sum(
        F.when(F.col("reached").isNull() | (F.col("start") >= F.col("reached")), 1).otherwise(0)
    ).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy(
        id_column, "text_hash", "island"
    ).agg(F.min("start").alias("start"), F.max("end").alias("end"),
          F.min_by("kind", F.struct("start", -F.col("end"))).alias("kind"))
    spans = merged.groupBy(id_column, "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_pii_spans")
    )
    whole, marks = F.col(text), F.col("_pii_spans")
    pieces = F.transform(marks, lambda s, i: F.concat(
        F.substring(whole, F.when(i == 0, 0).otherwise(F.get(marks, i - 1).getField("end")).cast("int") + 1,
                    (s.getField("start") - F.when(i == 0, 0).otherwise(F.get(marks, i - 1).getField("end"))).cast("int")),
        F.lit("["), F.upper(s.getField("kind")), F.lit("]"),
    ))
    last = F.element_at(marks, -1).getField("end").cast("int")
    rebuilt = F.concat(F.array_join(pieces, ""), F.substring(whole, last + 1, F.length(whole)))
    joined = _beside(rows, spans, id_column, text)
    return joined.withColumn(text, F.when(marks.isNotNull(), rebuilt).otherwise(whole)).select(rows.columns)


def digests(rows: DataFrame, judge: Judge | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id, the base spans of each kind counted, their digest, and all spans as text."""
    found = personal_spans(rows, judge, id_column, text)
    rank = functools.reduce(
        lambda made, i: made.when(F.col("kind") == KINDS[i], i), range(1, len(KINDS)),
        F.when(F.col("kind") == KINDS[0], 0),
    )
    span = F.struct("start", rank.alias("rank"), "end", "kind")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
            ":", s.getField("kind"), s.getField("start").cast("string"), s.getField("end").cast("string")
        )), ",")

    grouped = found.groupBy(id_column, "text_hash").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == kind), 1)).alias(f"n_{kind}") for kind in KINDS],
        F.count(F.when(~F.col("base"), 1)).alias("n_added"),
        F.sha2(joined(F.collect_list(F.when(F.col("base"), span))), 256).alias("base_sha256"),
        joined(F.collect_list(span)).alias("spans"),
    )
    counts = [*(f"n_{kind}" for kind in KINDS), "n_added"]
    # The hash stands for the text in the join, so that texts are not shuffled.
    return _beside(rows.select(id_column, text), grouped, id_column, text).select(
        id_column, *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counts],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
