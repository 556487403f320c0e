"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions throughout.

The forest is trained by Spark's own learner on labelled findings and then written out as a column
expression, so that scoring and masking work inside a row: no explode, no shuffle, no Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.scratch import saved

KNOWN_PREFIX = r"^(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{30,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{30,}|eyJ[A-Za-z0-9_\-]{20,}|glpat-[A-Za-z0-9_\-]{16,})"

_RUN, _NO_DIGIT = r"[A-Za-z0-9+/_\-]", r"[A-Za-z+/_\-]"
#: Inside a run of token characters: the start of a known shape after a separator. Counts are the least ones, so a look ahead is bounded.
_INNER = r"(?<=[+/_\-])" + re.sub(r"([0-9]+),\}", r"\1}", KNOWN_PREFIX[1:])
_END = rf"(?:(?!{_RUN})={{0,2}}|(?={_INNER}))"
#: Names that are set to secrets.
SECRET_NAME = r"(?:pass(?:word|wd|phrase)|pwd|secret|token|credentials?|(?:api|access|auth|private|secret)[_\- ]?key)"
#: What a secret's name is set to: 8 or more characters up to white space, a quote or an angle bracket, if not quoted without closing punctuation.
_VALUE = r"[^\s\"'<>]{7,}[^\s\"'<>.,;:!?)\]}]"
#: A candidate: the whole of what a secret's name is set to, unless that leads to a known shape; 16 or more characters of a
#: token with a digit among them, of any length; or a known shape inside such a run, after a path or a name, where the run before it ends.
CANDIDATE = (
    rf"(?<=[:=>][ ]{{0,2}}[\"']?)(?i:(?<={SECRET_NAME}[\"']?[ ]{{0,2}}[:=]=?>?[ ]{{0,2}}[\"']?))(?![\"' ])(?!{_RUN}*?{_INNER})(?:(?<=[\"'])[^\s\"'<>]{{8,}}|(?<![\"']){_VALUE})"
    rf"|(?<!{_RUN})(?={_NO_DIGIT}*+[0-9])(?={_RUN}{{16}})(?!(?:{_NO_DIGIT}+|{_RUN}{{1,15}}){_INNER}){_RUN}{{16,}}?{_END}"
    rf"|(?={_INNER}){_RUN}+?{_END}"
)
#: What every text with a candidate has: a run as long as the shortest known shape, or something set to 8 characters.
MAY_HOLD = rf"(?<!{_RUN}){_RUN}{{15}}|[:=>][ ]{{0,2}}[\"']?[^\s\"'<>]{{8}}"
BEFORE, AFTER = 60, 40
MASK = "[secret]"

#: Words that make up names and prose rather than secrets.
DICTIONARY = (
    "access account admin alpha api application archive article asset author auth backup base beta branch build cache card category change changeme class client cloud code comment commit "
    "component config connection content controller core customer data database date debug default demo deploy design detail device digest disable document domain download draft dummy edit "
    "element email enable encoding engine entity entry error event example export factory fake feature file filter final fixture folder font form format frame function gallery global group "
    "handler hash header hello host html http image import index info input install instance integration internal issue item java json key label language layout level library license line link "
    "list load local location login main manager master media member message meta method migration model module name network node note notification number object option order output package "
    "page parameter parse partner password path payload payment placeholder platform player plugin policy post preview private process product production profile project property provider public "
    "query record reference region register release report repository request resource response result review role route sample schema script search secret section security server service "
    "session setting shop simple size snapshot source sprint stable staging start state static status storage store story string style support system table target task template test text "
    "theme thread ticket time title token tool topic track type update upload user utility value version video view widget window work world yellow"
).split()
#: Common letter pairs of European languages.
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|ue|la|ei|ie|un|ge|ns|em|qu|ai|el|os|do|ad|ci"
#: Words beside secrets, words beside look-alikes, places where look-alikes live, places where secrets live.
NEAR_SECRET = r"(?i)token|secret|passw|pwd|api.?key|access.?key|auth|credential|bearer|private"
NEAR_OTHER = r"(?i)example|sample|commit|checksum|sha-?\d|md5|uuid|guid|hash|digest|dummy|fake|placeholder|version|revision|etag|build|session.?id|order|tracking|isbn|image|base64,|integrity|permalink|https?:"
PATH_OTHER = r"(?i)test|spec|fixture|example|sample|doc|vendor|lock|mock|demo|readme"
PATH_SECRET = r"(?i)\.env|config|setting|credential|deploy|secret|\.ya?ml|\.ini|\.properties"

TREES, DEPTH, SEED, LABELLED_ROWS = 24, 6, 7, 6_000


def feature_columns(token: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Return the forest's inputs of one candidate, all doubles and never null."""
    length = F.greatest(F.char_length(token), F.lit(1)).cast("double")
    count = lambda pattern, text=token: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    letters = F.greatest(count("[A-Za-z]"), F.lit(1.0))
    rest = F.regexp_replace(F.lower(token), "(?:" + "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)) + ")", "")
    around = F.concat_ws(" ", before, after)
    return {
        "length": length,
        "digits": count("[0-9]") / length,
        "upper": count("[A-Z]") / length,
        "separators": count(r"[^A-Za-z0-9]") / length,
        "transitions": count(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / length,
        "pairs": count(f"(?i)(?=(?:{PAIRS}))") / letters,
        "distinct": F.size(F.array_distinct(F.split(token, ""))).cast("double") / F.least(length, F.lit(40.0)),
        "coverage": 1 - F.char_length(rest) / length,
        "hex": flag(F.rlike(token, F.lit("^[0-9a-fA-F]+$"))),
        "uuid": flag(F.rlike(token, F.lit("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"))),
        "known": flag(F.rlike(token, F.lit(KNOWN_PREFIX))),
        "assigned": flag(F.rlike(before, F.lit(r"[:=]\s*[\"']?$"))),
        "near_secret": flag(F.rlike(before, F.lit(NEAR_SECRET))),
        "near_other": flag(F.rlike(around, F.lit(NEAR_OTHER))),
        "path_secret": flag(F.rlike(path, F.lit(PATH_SECRET))),
        "path_other": flag(F.rlike(path, F.lit(PATH_OTHER))),
    }


FEATURES = list(range(16))


def _chars(alphabet: str, n: Column | int, seed: Column) -> Column:
    """Make a reproducible string: the n-th character is drawn by a hash of the row's seed and n."""
    n = F.lit(n) if isinstance(n, int) else n
    at = lambda i: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(seed, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), at), "")


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS, start: int = 0) -> DataFrame:
    """Make labelled findings by rule: token, before, after, path, label (1: a secret).

    Real findings carry real secrets and cannot be kept in a repository. These follow the published
    shapes of access tokens, and of what scanners take for them: digests, ids, slugs, names, encoded images.
    """
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    i = F.col("id")
    word = lambda k: F.element_at(F.split(F.lit(" ".join(DICTIONARY)), " "), (F.pmod(F.xxhash64(i, F.lit(f"w{k}")), F.lit(len(DICTIONARY))) + 1).cast("int"))
    pick = lambda k, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    size = lambda k, a, b: (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(b - a + 1)) + a).cast("int")
    hexes = _chars(num + "abcdef", pick("h", 32, 40, 64).cast("int"), i)
    mixed = _chars(low + up + num, size("m", 20, 48), i)
    prose = F.concat_ws(" ", word(1), word(2), word(3))
    name = pick("n", "token", "secret", "api_key", "API-KEY", "access_token", "password", "auth token", "client_secret", "private key")
    sign = pick("s", ' = "', "=", ": ", ": '", ' := "', " ")
    other = pick("o", "commit", "checksum:", "sha256:", "md5 ", "uuid ", "etag: ", "version ", "build ", "digest = ", "example key ", "revision=", "integrity: sha512-", "order ")
    chosen = F.concat(_chars(low + up + num, size("c", 4, 12), i), pick("C", "!", "$", "#", "@", "%", "&", "*"), _chars(low + num + up + "!$#@%&*", size("d", 4, 14), F.xxhash64(i, F.lit("t"))))
    # A chosen password has signs in it.
    secret = pick("k", hexes, hexes, hexes, mixed, mixed, chosen, _chars(low + num, size("s", 9, 15), i), F.concat(F.lit("AKIA"), _chars(up + num, 16, i)), F.concat(F.lit("ghp_"), _chars(low + up + num, 36, i)),
                  F.concat(F.lit("sk_live_"), _chars(low + up + num, 24, i)), F.concat(_chars(low + up + num + "+/", 43, i), F.lit("=")), F.concat(F.lit("eyJ"), _chars(low + up + num + "_-", size("j", 30, 90), i)))
    # Fixed words of prose often stand right before a bare secret, so a known shape needs no name.
    known = F.rlike(secret, F.lit(KNOWN_PREFIX))
    lead = F.when(known & (F.pmod(F.xxhash64(i, F.lit("q")), F.lit(3)) == 0), F.concat(prose, F.lit(" "))).otherwise(F.concat(prose, F.lit(" "), name, F.when((sign == " ") & ~F.rlike(secret, F.lit(rf"^{_RUN}{{16}}")), "=").otherwise(sign)))
    clock = _chars(num, 2, i)
    # What prose and code put after a secret's name is words.
    told = pick("T", F.array_join(F.transform(F.sequence(F.lit(1), size("sp", 4, 7)), lambda k: F.element_at(F.split(F.lit(PAIRS), r"\|"), (F.pmod(F.xxhash64(i, k), F.lit(PAIRS.count("|") + 1)) + 1).cast("int"))), ""), F.concat(word(4), word(5)), F.concat(word(4), F.lit("."), word(5), F.lit("[")), F.concat_ws("-", word(4), word(5)), F.concat(word(4), F.lit("("), word(5)), F.concat_ws(".", word(4), word(5), word(6)), F.concat(F.lit("${"), F.upper(word(4)), F.lit("_"), F.upper(word(5))), F.concat(F.lit("{{"), word(4), F.lit("."), word(5)))
    fake = pick("f", F.concat_ws("-", word(4), word(5), word(6), clock), F.concat_ws("_", word(4), word(5), word(6), clock), F.concat(F.initcap(word(4)), F.initcap(word(5)), F.initcap(word(6)), clock),
                F.concat_ws("/", word(4), word(5), word(6), clock), _chars(num, size("d", 16, 24), i), F.repeat(F.concat(F.lit("x"), F.lit("0")), 12), F.concat(F.lit("changeme"), _chars(num, 8, i)),
                F.concat(F.lit("EXAMPLE_KEY_"), _chars(num, 6, i)), F.concat(F.lit("your_"), word(4), F.lit("_token_"), word(5), F.lit("_1234")))
    ids = F.concat_ws("-", *[_chars(num + "abcdef", n, F.xxhash64(i, F.lit(n + j))) for j, n in enumerate((8, 4, 4, 4, 12))])
    lure = pick("l", fake, fake, fake, hexes, ids, mixed, told)
    is_told = F.pmod(F.xxhash64(i, F.lit("l")), F.lit(7)) == 6
    # A digest, an id or a random string is taken for one only beside words that say so; a slug also where a secret's name stands.
    lure_lead = F.when(is_told, F.concat(prose, F.lit(" "), name, sign)).when(F.rlike(lure, F.lit("(?i)change|example|your_|x0x0|-|_|/")) & ~F.rlike(lure, F.lit("^[0-9a-f-]{36}$")), F.concat(prose, F.lit(" "), pick("g", name, other, word(7)), sign)).when(
        F.rlike(lure, F.lit("^[0-9]+$")), F.concat(prose, F.lit(" "))).otherwise(F.concat(prose, F.lit(" "), other))
    is_secret = F.pmod(F.xxhash64(i, F.lit("label")), F.lit(2)) == 0
    neutral = pick("p", "src7", "web", "", "src/app/main.py", "notes.txt")
    path = F.when(is_secret, pick("P", neutral, neutral, "deploy/.env", "config/settings.yaml")).otherwise(pick("Q", neutral, neutral, "tests/fixtures/data.json", "docs/readme.md", "package-lock.json"))
    return spark.range(start, start + rows).select(
        F.when(is_secret, secret).otherwise(lure).alias("token"), F.when(is_secret, lead).otherwise(lure_lead).alias("before"),
        F.concat(pick("a", '"', "'", "", ";"), F.lit(" "), word(8), F.lit(" "), word(9)).alias("after"), path.alias("path"), is_secret.cast("double").alias("label"),
    )


def fit_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """Fit Spark's random forest on labelled findings, a bounded table; return the model and the features it was fitted on."""
    names = list(feature_columns(F.lit(""), F.lit(""), F.lit(""), F.lit("")))
    rows = findings.select("label", *[c.alias(n) for n, c in feature_columns(F.col("token"), F.col("before"), F.col("after"), F.col("path")).items()])
    # The learner goes over its rows several times.
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(saved(rows, "findings")).select("features", "label").coalesce(2)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="onethird").fit(vectors), vectors


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """Return the trees of a fitted forest, nested as (feature, threshold, left, right) or shares of secrets."""
    return forest_trees(fit_forest(findings, trees, depth, seed)[0])


def forest_trees(model) -> list:
    def walk(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats)
        split = node.split()
        return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return [walk(tree._java_obj.rootNode()) for tree in model.trees]


def forest_column(trees: list, features: list[Column]) -> Column:
    """Write a forest as a column: the mean share of secrets in the leaves that the features lead to."""

    def tree(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        at, threshold, left, right = node
        return F.when(features[at] <= F.lit(threshold), tree(left)).otherwise(tree(right))

    return reduce(lambda a, b: a + b, [tree(t) for t in trees]) / F.lit(float(len(trees)))


def candidates(text: Column) -> tuple[Column, Column]:
    """Return a text's candidates and the pieces between them, one more than candidates; both hold the whole text together."""
    text = F.coalesce(text, F.lit(""))
    may = F.rlike(text, F.lit(MAY_HOLD))
    found = F.when(may, F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return found, F.when(may, F.split(text, CANDIDATE, -1)).otherwise(F.array(text))


def scan(documents: DataFrame, trees: list, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Add _found, an array of struct(token, before, after, gap, score) with a finding per candidate in text order, and _pieces.

    Null and empty texts have no findings. gap: code points between the token and what stands before. All rows and columns stay.
    """
    tokens, pieces = candidates(F.col(text_col))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in documents.columns else F.lit("")
    rows = documents.withColumns({"_tokens": tokens, "_pieces": pieces})
    # Texts without a candidate, nearly all, skip the rest.
    n = F.size("_tokens")
    window = F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.struct(
            F.element_at("_tokens", k).alias("token"), F.right(F.concat_ws("", F.get("_tokens", k - 2), F.right(F.element_at("_pieces", k), F.lit(BEFORE))), F.lit(BEFORE)).alias("before"),
            F.left(F.concat_ws("", F.left(F.element_at("_pieces", k + 1), F.lit(AFTER)), F.get("_tokens", k)), F.lit(AFTER)).alias("after"),
            F.element_at("_pieces", k).alias("_piece"),
        ),
    )

    def features(c: Column) -> Column:
        values = list(feature_columns(c["token"], c["before"], c["after"], path).values())
        return F.struct(c["token"].alias("token"), c["before"].alias("before"), c["after"].alias("after"), F.char_length(c["_piece"]).alias("gap"), F.array(*values).alias("x"))

    rows = rows.withColumn("_raw", F.when(n > 0, F.transform(window, features)))

    def scored(c: Column) -> Column:
        x = [F.get(c["x"], F.lit(i)) for i in FEATURES]
        return F.struct(c["token"].alias("token"), c["before"].alias("before"), c["after"].alias("after"), c["gap"].alias("gap"), forest_column(trees, x).alias("score"))

    return rows.withColumn("_found", F.coalesce(F.transform("_raw", scored), F.array().cast("array<struct<token:string,before:string,after:string,gap:int,score:double>>"))).drop("_raw", "_tokens")


def mask_secrets(documents: DataFrame, trees: list | None = None, threshold: float = 0.5) -> DataFrame:
    """Replace the secrets in every text by MASK and set n_chars; false positives and all other text stay. Columns as in documents."""
    trees = trees or train_forest(labelled_findings(documents.sparkSession))
    rows = scan(documents, trees)
    shown = F.transform("_found", lambda c: F.when(c["score"] >= threshold, F.lit(MASK)).otherwise(c["token"]))
    whole = F.array_join(F.flatten(F.zip_with("_pieces", shown, lambda p, t: F.array(p, F.coalesce(t, F.lit(""))))), "")
    found = F.exists("_found", lambda c: c["score"] >= threshold)
    rows = rows.withColumn("text", F.when(found, whole).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.when(found, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(documents.columns)


def op2_secret_scan(documents: DataFrame) -> DataFrame:
    """Scan every whole text: a row per candidate with its number in the document, kind, length, digest, score and verdict."""
    trees = train_forest(labelled_findings(documents.sparkSession))
    rows = scan(documents.select("doc_id", "text", "source"), trees).where(F.size("_found") > 0)
    rows = rows.select("doc_id", F.posexplode("_found").alias("nr", "f"))
    kind = F.when(F.rlike("f.token", F.lit(KNOWN_PREFIX)), "known").when(F.rlike("f.token", F.lit("^[0-9a-fA-F]+$")), "hex").when(F.rlike("f.token", F.lit("^[A-Za-z0-9]+$")), "mixed").otherwise("other")
    return rows.select("doc_id", "nr", kind.alias("kind"), F.char_length("f.token").cast("long").alias("length"), F.sha2(F.col("f.token").cast("binary"), 256).alias("token_sha256"),
                       F.round("f.score", 9).alias("score"), (F.col("f.score") >= 0.5).cast("int").alias("is_secret"))
