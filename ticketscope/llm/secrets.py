"""Operator 8: secret scans with a random forest. DataFrame functions only.

Candidates are values assigned to a secret word (of any length and characters), passwords in
addresses, blocks of private keys, values with a known beginning, and runs of at least twelve
letters, digits and + / _ - that hold a digit. A random
forest judges each by its length, the characters it has and how they change, the share of it that
dictionary words cover, the path it stands in, and the words beside it. It is trained on labelled
findings that are made here from invented values: keys, tokens and passwords on one side; check
sums, commit and object ids, UUIDs, numbers, paths, identifiers and placeholders on the other.

A text is cut at its candidates once, so that the cost of very long texts is linear. The same
text under the same id is scanned once. Null and empty texts have no findings, rows without an id
are scanned like others; extra columns are ignored; an empty table gives an empty result. Start
and length count characters, and the value itself is not in the result.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import table

MASK = "[SECRET]"
THRESHOLD = 0.5
# Labelled findings that are made, and the forest's size.
EXAMPLES, TREES, DEPTH = 9_000, 24, 10

_QUOTE = "[\"'`]"
_SECRET_NAMES = (
    r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|secret[_\-]?key"
    r"|auth|bearer|credentials?|signing[_\-]?key|encryption[_\-]?key|client[_\-]?secret|jwt|webhook)"
)
_KEY_TEXT = r"[A-Za-z0-9+/=]"
# What stands before an assigned value. The short form is looked at first, as it is cheap.
_ASSIGNED = rf"(?<=[=:]>?\s{{0,3}}{_QUOTE}?)(?<={_SECRET_NAMES}{_QUOTE}?\s{{0,3}}[=:]{{1,2}}>?\s{{0,3}}{_QUOTE}?)"
_PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|rk_live_|xox[abp]-|AIza|eyJ|hf_|npm_|SG[.]"
_CANDIDATE = "|".join((
    # a block of a private key
    rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:\s+{_KEY_TEXT}{{16,}}+)*+(?:\s+{_KEY_TEXT}++(?=\s*-----END))?"
    r"(?:\s*-----END [A-Z ]{0,30}-----)?",
    # a password in an address
    r"(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s/@]++(?=@)",
    # a value that is assigned to a secret word, in quotes or not
    rf"{_ASSIGNED}(?:(?<={_QUOTE})[^\"'`\n]++(?={_QUOTE})|(?!{_QUOTE})[^\s\"'`,;<>(){{}}\[\]]++)",
    # a known beginning
    rf"(?<![A-Za-z0-9+/_\-])(?:{_PREFIXES})[A-Za-z0-9+/_\-]{{8,}}+",
    # a long run with a digit
    r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{12,}+={0,2}",
))
_BEFORE, _AFTER = 48, 24
_PREFIX = rf"^(?:{_PREFIXES})"
_SECRET_WORDS = (
    r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth"
    r"|bearer|credential|signing|encryption[_-]?key|client[_-]?secret|jwt|webhook|key)"
)
_HARMLESS_WORDS = (
    r"(?i)(?:commit|revision|sha-?\d*|md5|checksum|digest|hash|etag|uuid|guid|build|version|isbn|order"
    r"|invoice|serial|tracking|phone|card|account|example|sample|dummy|placeholder|test|integrity"
    r"|image|layer|object|request|trace|session[_-]?id|user[_-]?id|file)"
)
_DICTIONARY = (
    "about above access account address admin after again agent album animal answer apple archive "
    "article author backup banner before begin better black block board books branch bread bridge "
    "bring build button cache center chapter check child choice class clean client close cloud code "
    "color column common config content copy count country cover create data date default delete "
    "design detail device dinner document domain draft drive earth east edit email empty energy engine "
    "entry error event example export factory family field figure file filter final find first folder "
    "forest form frame free from front garden general girl glass global going good grand graph green "
    "group guide hand handler header health heart hello help history home host house human image import "
    "index info input install item january july june kernel label language large last layer learn left "
    "letter level library light limit line link list local login logo long machine mail main manager map "
    "market master match media member memory menu message method middle model module money month moon "
    "morning mother mountain music name network news next night north note number object office open "
    "option order other output owner package page paper parent park party path pattern people person "
    "phone photo picture place plan plant play plugin point policy post power price print private process "
    "product profile program project public question queue quick radio reader record region release "
    "remote report request reset resource result return review right river road root round sample save "
    "scale school schema screen script search second section select self send server service session "
    "setting shape share sheet short show side simple site size small social sound source south space "
    "special spring staff stage star start state static station status stock storage store story stream "
    "street string student style subject summer sun support system table target task team template test "
    "text theme thing time title today tool total track train travel tree type under unit update upload "
    "user value version video view visit voice wall watch water weather week west white window winter "
    "woman wood word work world write year young"
).split()
FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "distinct", "changes", "is_hex", "is_digits",
    "is_uuid", "known_prefix", "coverage", "slashes", "dashes", "path_near", "path_harmless",
    "secret_word", "near_secret_word", "harmless_word", "assigned", "quoted", "odd_length",
    "punctuation", "spaces", "in_address", "key_block", "is_word", "is_filler", "is_reference", "vowels",
)


def candidates(rows: DataFrame, id_column: str = "doc_id", text: str = "text",
               path: str | None = None) -> DataFrame:
    """(id, text_hash, place, start, c, before, after, path) of every candidate."""
    found = rows.filter(F.col(text).rlike(_CANDIDATE)).select(
        F.col(id_column), F.xxhash64(text).alias("text_hash"),
        (F.coalesce(F.col(path), F.lit("")) if path else F.lit("")).alias("path"),
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(_CANDIDATE), 0).alias("c"),
            F.split(text, _CANDIDATE).alias("gap"),
        ).alias("cut"),
    )
    near = found.select(
        id_column, "text_hash", "path",
        F.posexplode(F.transform("cut", lambda x, i: F.struct(
            x.getField("c").alias("c"),
            F.length(x.getField("gap")).cast("long").alias("gap"),
            F.right(x.getField("gap"), F.lit(_BEFORE)).alias("before"),
            F.left(F.coalesce(F.get("cut", i + 1).getField("gap"), F.lit("")), F.lit(_AFTER)).alias("after"),
        ))).alias("place", "x"),
    ).select(id_column, "text_hash", "path", "place", "x.*").dropDuplicates([id_column, "text_hash", "place"])
    own = Window.partitionBy(id_column, "text_hash").orderBy("place")
    start = F.sum(F.col("gap") + F.coalesce(F.length("c"), F.lit(0))).over(own) - F.length("c")
    return near.withColumn("start", start).filter(F.col("c").isNotNull()).drop("gap")


def _count(value: Column, pattern: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))


def with_features(rows: DataFrame) -> DataFrame:
    """The features of the columns c, before, after and path."""
    c, before = F.col("c"), F.col("before")
    size = F.length(c)
    low = F.lower(c)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.regexp_replace(c, "[0-9]+", "\u0001"), "[a-z]+", "\u0002"), "[A-Z]+", "\u0003"), "[+/_=-]+", "\u0004")
    words = "(?:" + "|".join(sorted(_DICTIONARY, key=len, reverse=True)) + ")"
    last = F.regexp_extract(before, r"([A-Za-z_\-]+)[\"'`]?\s*(?:=>?|:|is)?\s*[\"'`(]*$", 1)
    features = {
        "length": size, "digits": _count(c, "[0-9]") / size, "uppers": _count(c, "[A-Z]") / size,
        "lowers": _count(c, "[a-z]") / size, "signs": _count(c, "[+/_=-]") / size,
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / F.least(size, F.lit(32)),
        "changes": F.length(kinds) / size,
        "is_hex": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "is_digits": c.rlike("^[0-9+/_=-]+$"),
        "is_uuid": low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "known_prefix": c.rlike(_PREFIX), "coverage": _count(low, words) / size,
        "slashes": _count(c, "/"), "dashes": _count(c, "[_-]"),
        "path_near": before.rlike(r"(?:https?://|[./~]|[A-Za-z0-9]/)\S*$"),
        "path_harmless": F.col("path").rlike("(?i)test|example|sample|fixture|doc|lock"),
        "secret_word": last.rlike(_SECRET_WORDS), "near_secret_word": before.rlike(_SECRET_WORDS),
        "harmless_word": last.rlike(_HARMLESS_WORDS) | F.right(before, F.lit(16)).rlike(_HARMLESS_WORDS),
        "assigned": before.rlike(r"[=:]\s*[\"'`]?$"),
        "quoted": before.rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]"),
        "odd_length": ~size.isin(32, 40, 56, 64, 96, 128),
        "punctuation": _count(c, r"[^A-Za-z0-9+/_=\s-]") / size, "spaces": _count(c, r"\s"),
        "in_address": before.rlike(r"://[^\s:/@]+:$"), "key_block": c.startswith("-----BEGIN"),
        "is_word": c.rlike("^(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,12})[.!?]?$") | low.rlike(f"^{words}$"),
        "is_filler": low.rlike(r"^(?:[x*.\-#]+|null|none|true|false|required|optional|undefined|redacted|hidden)$"
                               r"|change|your|example|dummy|placeholder|os\.|env|get|config"),
        "is_reference": low.rlike(r"^(?:[$<%{].*[}>%]|\$[a-z_]+)$"),
        "vowels": _count(low, "[aeiou]") / size,
    }
    return rows.select("*", *[features[name].cast("double").alias(name) for name in FEATURES])


def labelled_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(c, before, after, path, label): made findings of known kind."""
    rows = spark.range(0, n, 1, 4)

    def pick(salt: int, values: list[str]) -> Column:
        place = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1
        # One literal, not a call of the JVM for each value.
        return F.element_at(F.split(F.lit("\n".join(values)), "\n"), place.cast("int"))

    rows = rows.withColumns(
        {f"word{k}": pick(10 + k, _DICTIONARY) for k in range(4)} | {
            "digest": F.sha2(F.concat(F.lit("seed"), F.col("id").cast("string")), 512),
            "more": F.sha2(F.concat(F.lit("other"), F.col("id").cast("string")), 512),
        }
    )
    digest, more = F.col("digest"), F.col("more")
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "[=\n\r]", "")
    plain = F.regexp_replace(mixed, "[+/]", "x")
    size = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).cast("int") + 14
    word = [F.col(f"word{k}") for k in range(4)]
    secret_names = ["password", "passwd", "token", "secret", "api_key", "API_KEY", "apikey", "auth_token",
                    "access_key", "client_secret", "private_key", "SECRET_KEY", "bearer", "pwd", "TOKEN"]
    joins = [" = \"", "=", ": ", ": \"", "=\"", " = '", "=> '", "\": \"", " "]
    prose = F.concat(word[0], F.lit(" "), word[1], F.lit(" "))
    named = F.concat(prose, pick(3, secret_names), pick(2, joins))
    harmless = ["commit ", "revision ", "sha256:", "md5 ", "checksum: ", "digest=", "etag: \"", "hash ", "uuid ",
                "build ", "object ", "image ", "request id ", "trace ", "integrity=\"sha512-", "order ", "file "]
    quiet = F.concat(prose, pick(4, harmless))
    url = F.concat(prose, F.lit("https://"), word[2], F.lit(".com/"), word[3], F.lit("/"))
    hexed = F.left(digest, F.element_at(F.array(*map(F.lit, [32, 40, 64])), (F.pmod("id", F.lit(3)) + 1).cast("int")))
    uuid = F.concat_ws("-", *[F.substring(more, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    digits = F.left(F.regexp_replace(more, "[a-f]", "7"), F.element_at(F.array(*map(F.lit, [12, 13, 16, 20])), (F.pmod("id", F.lit(4)) + 1).cast("int")))
    identifier = F.regexp_replace(
        F.concat_ws("_", *word, F.pmod("id", F.lit(97)).cast("string")), F.lit("_"), pick(5, ["_", "-", "/"])
    )
    joined = F.concat(*word, F.pmod("id", F.lit(97)).cast("string"))
    filler = F.concat(pick(6, ["your", "xxxx", "changeme", "EXAMPLE", "dummy"]), F.lit("_"), word[0], F.lit("_"),
                      pick(7, ["1234", "0000", "12345678", "1"]), F.lit("_"), word[1])
    prefix = pick(8, ["AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "hf_", "npm_", "sk-"])
    plain_prose = F.concat(prose, word[2], F.lit(" "))
    letters = F.left(F.translate(digest, "0123456789", "ghjkmpqrst"), size + 4)
    number = F.left(F.translate(more, "abcdef", "274916"), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    mark = pick(30, ["!", "&", "#", "@", "$", "*", "?", "%"])
    leet = F.translate(F.initcap(word[0]), "aeo", "430")
    password = F.element_at(F.array(
        F.concat(leet, mark, number), F.concat(word[0], mark, word[1], number), F.concat(leet, number, mark),
        F.concat(word[0], number), F.concat(F.left(plain, F.lit(6)), mark, F.left(letters, F.lit(4))),
    ), (F.pmod(F.xxhash64("id", F.lit(31)), F.lit(5)) + 1).cast("int"))
    blank = pick(32, ["none", "true", "false", "null", "required", "optional", "********", "xxxx", "${TOKEN}", "undefined",
                      "changeme", "your_password", "os.environ", "config.get", "hidden", "...", "None"])
    address = F.concat(prose, pick(33, ["postgres://", "mysql://", "https://", "redis://", "amqp://"]), word[2], F.lit(":"))
    block = F.concat(F.lit("-----BEGIN PRIVATE KEY----- "), mixed, F.lit(" "), F.left(plain, F.lit(20)), F.lit(" -----END PRIVATE KEY-----"))
    # Columns of their own, so that no expression holds another many times over.
    made = {
        "named": named, "quiet": quiet, "url": url, "hexed": hexed, "uuid": uuid, "digits": digits, "identifier": identifier,
        "joined": joined, "filler": filler, "prefix": prefix, "plain_prose": plain_prose, "mixed": mixed, "plain": plain,
        "size": size, "letters": letters, "password": password, "blank": blank, "address": address, "block": block,
    }
    rows = rows.withColumns({f"made_{name}": column for name, column in made.items()})
    (named, quiet, url, hexed, uuid, digits, identifier, joined, filler, prefix, plain_prose, mixed, plain, size,
     letters, password, blank, address, block) = (F.col(f"made_{name}") for name in made)
    kinds = [
        (1, F.left(mixed, size), named), (1, F.left(plain, size), named),
        (1, hexed, named), (1, F.left(digest, size), named),
        (1, F.concat(prefix, F.left(plain, F.lit(24))), named),
        (1, F.concat(prefix, F.left(plain, F.lit(24))), plain_prose),
        (1, F.upper(hexed), F.upper(named)), (1, F.left(mixed, F.lit(44)), F.concat(prose, pick(3, secret_names), F.lit(" "))),
        (1, F.concat(word[0], F.left(plain, F.lit(10)), F.lit("42")), named),
        (1, password, named), (1, password, named), (1, password, address), (1, letters, named), (1, block, prose),
        (1, F.concat(prefix, F.upper(letters)), named), (1, F.concat_ws(" ", *word), F.concat(prose, pick(3, secret_names), F.lit(" = \""))),
        (0, F.concat(F.lit("${"), F.upper(word[1]), F.lit("}")), named), (0, F.concat(F.lit("<"), word[1], F.lit("-"), word[2], F.lit(">")), named),
        (0, F.concat(F.lit("{{ "), word[1], F.lit("."), word[2], F.lit(" }}")), named), (0, word[0], named), (0, F.initcap(word[1]), named), (0, blank, named), (0, blank, named), (0, word[3], F.concat(prose, pick(3, secret_names), F.lit(": "))),
        (0, hexed, quiet), (0, hexed, plain_prose), (0, uuid, quiet), (0, uuid, plain_prose),
        (0, digits, plain_prose), (0, digits, quiet), (0, identifier, plain_prose), (0, identifier, url),
        (0, joined, plain_prose), (0, filler, named), (0, F.left(plain, size), url),
        (0, mixed, F.concat(prose, F.lit("data:image/png;base64,"))), (0, identifier, named),
        (0, F.upper(joined), plain_prose), (0, digits, F.concat(prose, word[2], F.lit(": "))),
    ]
    place = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(len(kinds)))

    def chosen(part: int) -> Column:
        found = None
        for i, kind in enumerate(kinds):
            value = F.lit(kind[part]) if part == 0 else kind[part]
            found = F.when(place == i, value) if found is None else found.when(place == i, value)
        return found

    made = rows.select(
        "id", chosen(1).alias("c"), chosen(2).alias("context"), word[3].alias("next"),
        chosen(0).cast("double").alias("label"),
    )
    # A quote that is opened is closed, whatever the finding is.
    closing = F.coalesce(F.nullif(F.regexp_extract("context", "[\"']$", 0), F.lit("")), F.lit(" "))
    # No kind is ever empty. A filter here would take a copy of all that makes c to the rows' source.
    return made.select(
        "c", F.right("context", F.lit(_BEFORE)).alias("before"), F.concat(closing, F.col("next")).alias("after"),
        F.when(F.pmod("id", F.lit(19)) == 0, "tests/sample.txt").otherwise("").alias("path"), "label",
    )


def train(spark: SparkSession) -> Model:
    """The forest, from the made findings."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        with_features(labelled_findings(spark))
    ).select("features", "label")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=8, maxBins=32, featureSubsetStrategy="0.5"
    )
    return forest.fit(data)


def judged(found: DataFrame, forest: Model) -> DataFrame:
    """Candidates with the forest's ``score``."""
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(found))
    scored = forest.transform(assembled)
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction", *FEATURES
    )


def scan(rows: DataFrame, forest: Model | None = None, id_column: str = "doc_id", text: str = "text",
         path: str | None = None) -> DataFrame:
    """(id, text_hash, place, start, length, score) of the candidates that are taken for secrets.

    ``path`` names a column that says where a text is from, such as a file path.
    """
    forest = forest or train(rows.sparkSession)
    found = judged(candidates(rows, id_column, text, path), forest).filter(F.col("score") >= THRESHOLD)
    return found.select(id_column, "text_hash", "place", "start", F.length("c").alias("length"), "score")


def redact(rows: DataFrame, forest: Model | None = None, id_column: str = "doc_id",
           text: str = "text", path: str | None = None) -> DataFrame:
    """The rows with ``MASK`` in place of every secret; their other columns stay as they are."""
    found = scan(rows, forest, id_column, text, path).groupBy(id_column, "text_hash").agg(
        F.collect_set("place").alias("_secret_places")
    ).withColumnsRenamed({id_column: "_secret_id", "text_hash": "_secret_hash"})
    same = F.col(id_column).eqNullSafe(F.col("_secret_id")) & (F.xxhash64(text) == F.col("_secret_hash"))
    joined = rows.join(found, same, "left")
    cut = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(_CANDIDATE), 0).alias("c"), F.split(text, _CANDIDATE).alias("gap")
    )
    rebuilt = F.array_join(F.transform(cut, lambda x, i: F.concat(
        x.getField("gap"),
        F.when(F.array_contains("_secret_places", i), F.lit(MASK)).otherwise(F.coalesce(x.getField("c"), F.lit(""))),
    )), "")
    return joined.withColumn(text, F.when(F.col("_secret_places").isNotNull(), rebuilt).otherwise(F.col(text))).select(
        rows.columns
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", "start", "length", "score")
