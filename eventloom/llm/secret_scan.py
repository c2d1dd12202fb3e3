"""Secret scanning: candidates by pattern, false positives removed by a random forest.

Candidates, in words between white space, are: what follows a secret word (``SECRET_WORDS``) and an assignment sign, in the same
word or the next ones, from ``SHORTEST_ASSIGNED`` characters on; what follows the prefix of a public credential format; and all
runs of at least ``SHORTEST`` characters that keys are made of, a digit among them.  Features
are the candidate's length, its character transitions and classes, the share that a small dictionary covers, whether it is
part of a path, and its neighbouring words.  A random forest is trained on labelled findings (a bounded table; by default
one generated from public credential formats and common false alarms) and written out as Column expressions.

Everything runs on built-in functions; the forest is trained by Spark's own library on the labelled table only.

Defined results: null or empty texts have no candidates; repeated rows are scanned one by one; a null ``doc_id`` stays
null; extra columns are ignored; of overlapping candidates the leftmost counts, an assigned value before others; each has the text from the
candidate before it to the candidate after it as its word.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORTEST = 12
SHORTEST_ASSIGNED = 6
#: Labelled findings that are generated if none are given.
FINDINGS = 9000
TREES, DEPTH, SEED = 25, 8, 42
THRESHOLD = 0.5

# Words beside secrets, and prefixes of public credential formats.
SECRET_WORDS = "token secret password passwd pwd apikey api_key key auth credential credentials bearer access private".split()
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ xoxa- xoxb- xoxp- sk- sk_live_ rk_live_ AIza eyJ glpat- npm_ hf_".split()

_RUN = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}"
_DIGIT = r"(?=[A-Za-z+/_-]*[0-9])"
_PREFIXED = rf"(?:{'|'.join(PREFIXES)})[A-Za-z0-9+/_.-]{{{SHORTEST},}}"
#: A run on its own; the first part is not inside a longer run.
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?:{_PREFIXED}|{_DIGIT}{_RUN})"
_KEY = rf"(?:{'|'.join(SECRET_WORDS)})"
_VALUE = rf"(?:(?!&\w+=)[^\s\"'<>,;]){{{SHORTEST_ASSIGNED},}}(?<![.:)])"
#: A secret word, an assignment sign and a value in one word, and what a value's word comes after.
ASSIGNED = rf"(?i){_KEY}[\"']?[:=>]{{1,2}}[\"']?{_VALUE}"
AFTER_KEY = rf"(?i){_KEY}[\"']?\s?[:=>]{{1,2}}[\"']?$"
IN_WORD = rf"(?:(?<=(?i:{_KEY})[\"']{{0,1}}[:=>]{{1,2}}[\"']{{0,1}})(?![:=>\"']){_VALUE}|{CANDIDATE})"
AT_START = rf"(?:(?<=^[\"'(]{{0,3}})(?![\"'(]){_VALUE}|{CANDIDATE})"

# Words that names, paths and placeholders are made of; words beside other long strings.
DICTIONARY = (
    "the and for with that this from test example sample user admin name data file image path home page index http https www com org net html json text"
    " value type code class model version build date time year report order number item list group main base form view table node event state server client"
    " config default local public master release update service system window button color width height style event handler module package library"
    " required optional none null true false undefined string your change changeme here placeholder redacted hidden secret password token key insert"
).split()
OTHER_WORDS = "commit sha sha1 sha256 md5 hash checksum digest uuid guid id phone tel fax card isbn order invoice ref build version page doi serial tracking".split()
FEATURES = (
    "length", "transitions", "digits", "uppers", "symbols", "hex", "all_digits", "repeats", "covered", "in_path", "dashed", "secret_before", "other_before", "assigned", "secret_inside", "signs", "cases",
)


def _any_of(words: list[str]) -> str:
    return r"(?i)(^|[^a-z])(" + "|".join(words) + r")([^a-z]|$)"


def features(rows: DataFrame) -> DataFrame:
    """With the columns ``FEATURES`` from ``candidate``, ``word`` (that holds it), ``before`` and ``before2`` (words); ``head`` is what precedes it in ``word``, if given."""
    c, word = F.col("candidate"), F.col("word")
    size = F.length(c).cast("double")
    share = lambda pattern: (size - F.length(F.regexp_replace(c, pattern, ""))) / size
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "0"), "[^ab0]", "-")
    head = F.col("head") if "head" in rows.columns else F.expr("substring_index(word, candidate, 1)")
    near = F.concat_ws(" ", F.coalesce("before2", F.lit("")), F.coalesce("before", F.lit("")), head)
    flag = lambda x: x.cast("double")
    dictionary = "(?i)(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")"
    return rows.withColumns(
        {
            "length": size,
            "transitions": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / size,
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "symbols": share("[A-Za-z0-9]"),
            "hex": flag(c.rlike("^[0-9a-fA-F]+$")),
            "all_digits": flag(c.rlike("^[0-9_/+-]+$")),
            "repeats": (size - F.length(F.regexp_replace(c, r"(.)\1+", "$1"))) / size,
            "covered": share(dictionary),
            "in_path": flag(word.rlike(r"(?i)(https?:|www\.|/[A-Za-z0-9_.-]+/|\.(com|org|net|html|png|jpg|js|css|py)\b)")),
            "dashed": flag(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-") | c.rlike(r"^\d{4}-\d{2}-\d{2}")),
            "secret_before": flag(near.rlike(_any_of(SECRET_WORDS))),
            "other_before": flag(near.rlike(_any_of(OTHER_WORDS))),
            "assigned": flag(near.rlike(r"[=:]\s*[\"']?\s*$") | head.rlike("[=:]")),
            "secret_inside": flag(c.rlike(f"^({'|'.join(PREFIXES)})")),
            "signs": share("[^A-Za-z0-9+/_=-]"),
            "cases": flag(c.rlike("[a-z]") & c.rlike("[A-Z]")) + flag(c.rlike("[0-9]")) + flag(c.rlike("[^A-Za-z0-9]")),
        }
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, word_index, word, head, before, before2, candidate``; texts without any candidate are passed over at once."""
    # a sign after white space or a secret word: looked for by the sign, which is rare
    likely = rf"{CANDIDATE}|[:=>](?:(?<=\s[:=>])|(?<=(?i:{_KEY})[\"']{{0,1}}[:=>]))"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(likely))
    words = rows.select("doc_id", F.split("text", r"\s+").alias("words"))
    near = lambda i, k: F.coalesce(F.get("words", i - k), F.lit(""))
    after_key = lambda i: F.concat_ws(" ", near(i, 2), near(i, 1)).rlike(AFTER_KEY)
    placed = F.transform("words", lambda w, i: F.struct(i.alias("word_index"), w.alias("word"), near(i, 1).alias("before"), near(i, 2).alias("before2"), after_key(i).alias("after_key")))
    found = F.filter(placed, lambda x: (F.length(x["word"]) >= SHORTEST_ASSIGNED) & (x["after_key"] | x["word"].rlike(CANDIDATE) | x["word"].rlike(ASSIGNED)))
    each = words.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")
    either = lambda f: F.when(F.col("after_key"), f(AT_START)).otherwise(f(IN_WORD))
    runs = either(lambda pattern: F.regexp_extract_all("word", F.lit(pattern), F.lit(0)))
    gaps = either(lambda pattern: F.split("word", pattern))  # one more than runs
    last, after = F.concat(F.array(F.lit("")), runs), F.slice(gaps, 2, F.size(gaps))
    parts = F.arrays_zip(runs.alias("run"), gaps.alias("gap"), last.alias("last"), after.alias("after"))
    each = each.select("doc_id", "word_index", "before", "before2", F.explode(parts).alias("p")).where("p.run is not null")
    head = F.concat("p.last", "p.gap")
    return each.select("doc_id", "word_index", F.concat(head, "p.run", "p.after").alias("word"), head.alias("head"), "before", "before2", F.col("p.run").alias("candidate"))


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``candidate, word, before, before2, label, shape``: generated findings, half of them secrets; ``shape`` numbers the template."""
    i = F.col("id")
    hexes = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 512)
    base = F.regexp_replace(F.base64(F.unhex(hexes)), "[^A-Za-z0-9+/]", "")
    plain = F.regexp_replace(base, "[^A-Za-z0-9]", "")
    upper, letters, number = F.upper(plain), F.regexp_replace(base, "[^A-Za-z]", ""), F.regexp_replace(hexes, "[^0-9]", "")
    some = lambda *texts, salt=0: F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(texts))) + 1).cast("int"))
    part = lambda text, size, at=1: F.substring(text, at, size)
    gap = some("_", "-", "/", "")
    names = lambda salt: some("user", "image", "test", "report", "index", "name", "file", "value", "default", "handler", salt=salt)
    first, second = some("trouble", "summer", "dragon", "falcon", "copper", "orchid", salt=1), some("horse", "monkey", "river", "staple", "battery", "lantern", salt=2)
    none = F.lit("")
    # (candidate, before2, before, head)
    secrets = [
        (F.concat(F.lit("AKIA"), part(upper, 16)), some("", "of", "key"), some("the", "is", "aws"), some("", '"key":"')),
        (part(hexes, 40), F.lit("token"), F.lit("="), some('"', "")),
        (part(hexes, 18), some("and", "the"), some("a", "of", "to"), F.lit("password=")),
        (part(base, 40), some("aws", "my"), some("secret:", "secret_key:", "secret"), none),
        (F.concat(F.lit("ghp_"), part(plain, 36)), F.lit("use"), some("token", "with"), none),
        (part(hexes, 32), some("the", "in"), some("api", "access", "this"), some("api_key=", "key:", "token=")),
        (F.concat(F.lit("sk_live_"), part(plain, 24)), F.lit("set"), some("key", "to"), none),
        (part(base, 24), some("user", "his"), some("password:", "pwd:", "passwd:"), none),
        (F.concat(F.initcap(first), part(number, 3), some("&", "!", "#", "@", "$"), part(hexes, 2)), some("the", "login"), some("with", "and"), some("password=", "pwd=", "passwd:")),
        (F.concat(first, second, some("", "gate", "lamp", salt=3)), some("my", "the"), some("password:", "secret:"), none),
        (F.concat(some("ghp_", "gho_"), part(letters, 30)), some("a", "the"), some("token", "is", "see"), none),
        (part(plain, 32), none, some("{", "", "with"), some('{"token":"', '"secret":"', "'api_key':'")),
        (F.concat(F.lit("xoxb-"), part(number, 10), F.lit("-"), part(plain, 24)), some("slack", "the"), some("bot", "token"), none),
        (F.concat(F.lit("eyJ"), part(base, 50)), some("authorization:", "the"), some("bearer", "token"), none),
        (F.concat(part(first, 4), some("@", "#", "!", "$"), part(number, 2), part(upper, 2)), F.lit("password"), some("=", ":"), some("", '"')),
        (F.concat(F.lit("AIza"), part(plain, 35)), some("key", "the"), some("is", "use"), some("", "key=")),
    ]
    alarms = [
        (part(number, 16), some("card", "the", "of"), some("number", "is", "a"), none),
        (part(hexes, 40), some("in", "see"), some("commit", "sha1", "checksum"), none),
        (F.concat_ws("-", part(hexes, 8), part(hexes, 4, 9), part(hexes, 4, 13), part(hexes, 4, 17), part(hexes, 12, 21)), F.lit("the"), some("id", "uuid", "item"), none),
        (F.concat(names(4), gap, names(5), gap, part(number, 4)), some("open", "see"), some("file", "the"), some("", "https://www.example.com/", "/home/")),
        (F.concat(some("2021-03-04", "2019-11-30"), F.lit("T120000"), part(number, 2)), F.lit("on"), F.lit("date"), none),
        (F.concat(some("thereandthat", "withoutanyof", "informations"), part(number, 2)), some("of", "the"), some("and", "is"), none),
        (F.concat(F.lit("+"), part(number, 12)), some("call", "the"), some("phone", "fax", "at"), none),
        (F.concat(F.lit("xxxxxxxxxxxx"), part(number, 1), F.lit("xxxx")), F.lit("your"), some("key", "token", "value"), some("", "key=")),
        (some("required", "optional", "changeme", "string", "hidden", "undefined", "your_password"), some("the", "a"), some("password:", "secret:", "token:"), none),
        (some("${TOKEN}", "${API_KEY}", "$(secret)", "%PASSWORD%", "{{password}}"), some("set", "export"), some("a", "the"), some("token=", "password=", "api_key=")),
        (some("primary", "foreign", "created_at", "user_name", "value", "string"), some("the", "a"), some("key:", "key="), some("", '"')),
        (part(hexes, 32), some("the", "etag"), some("md5", "hash:", "digest"), some("", "md5=")),
        (F.concat(F.initcap(names(6)), F.initcap(names(7)), part(number, 2)), some("call", "the"), some("function", "in", "class"), none),
        (F.concat(F.upper(names(8)), F.lit("_"), F.upper(names(9)), F.lit("_"), part(number, 4)), some("set", "the"), some("to", "of"), none),
        (F.concat(F.lit("97"), part(number, 11)), some("book", "the"), some("isbn", "number"), none),
        (F.concat(names(10), F.lit("-"), part(number, 1), F.lit("."), part(number, 2, 2), F.lit("-build"), part(number, 4, 4)), some("install", "the"), some("version", "package"), none),
    ]
    shapes = [(*s, 1) for s in secrets] + [(*s, 0) for s in alarms]
    shape = F.pmod(i, F.lit(len(shapes)))
    pick = lambda k: reduce(lambda rest, s: rest.when(shape == s[0], s[1][k]), list(enumerate(shapes))[1:], F.when(shape == 0, shapes[0][k]))
    rows = spark.range(n).select(pick(0).alias("candidate"), pick(1).alias("before2"), pick(2).alias("before"), pick(3).alias("head"), (shape < len(secrets)).cast("int").alias("label"), shape.alias("shape"))
    return rows.withColumn("word", F.concat("head", "candidate")).drop("head")


def train(findings: DataFrame) -> str:
    """The forest on labelled findings, as the text that Spark prints; ``findings`` is a bounded table."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(findings))
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    return forest.fit(rows).toDebugString


_IF = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)$")
_LEAF = re.compile(r"^\s*Predict: ([\d.]+)$")


def forest_score(text: str) -> Column:
    """The share of trees that vote secret, as one Column expression."""
    trees: list[list[str]] = []
    for line in text.split("\n"):
        if re.match(r"\s*Tree \d+", line):
            trees.append([])
        elif trees and line.strip():
            trees[-1].append(line)

    def parse(lines: list[str], at: int) -> tuple[Column, int]:
        if leaf := _LEAF.match(lines[at]):
            return F.lit(float(leaf[1])), at + 1
        test = _IF.match(lines[at])
        yes, at = parse(lines, at + 1)
        no, at = parse(lines, at + 1)  # the line between them is the matching Else
        return F.when(F.col(FEATURES[int(test[3])]) <= float(test[5]), yes).otherwise(no), at

    return reduce(lambda a, b: a + b, (parse(lines, 0)[0] for lines in trees)) / len(trees)


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per candidate: ``doc_id, word_index, candidate, score, is_secret``; one pass over the texts, no shuffle."""
    forest = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    scored = features(candidates(docs)).withColumn("score", forest_score(forest))
    return scored.select("doc_id", "word_index", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
