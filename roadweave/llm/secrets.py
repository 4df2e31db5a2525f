"""Secret scans in DataFrame functions alone: candidate tokens, features in SQL, a random forest as a SQL expression."""

from __future__ import annotations

import functools
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A candidate: 12 characters or more of these, a digit among them; or 6 or more of what follows a key word and = or :.
CANDIDATE = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_.-]{12,}={0,2}"
ASSIGNED = r"(?i)(?:pass(?:word|wd)?|pwd|token|secret|api_?-?key|access_?-?key|auth)[\"']?\s*[:=]\s*[\"']?([^\s\"',;]{6,})"
#: Fixed prefixes of well-known keys.
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk-|sk_live_|AIza|eyJ)"
KEY_WORDS = r"(?i)(pass(word|wd)?|pwd|token|secret|api_?-?key|access_?-?key|auth|bearer|credential|private)"
HARMLESS_WORDS = r"(?i)(example|sample|dummy|placeholder|changeme|xxxx|your|test|commit|sha1|sha256|md5|checksum|digest|uuid|version|isbn|http)"
#: Words of the dictionary whose share of a candidate's letters is measured.
DICTIONARY = (
    "about account action address admin after agent array async backup batch beta block branch build button cache change chart class client code color column command "
    "commit config connect content context control count create current data date debug default delete deploy design detail device docs domain download draft driver "
    "edit email entry error event example export factory false feature field file filter final folder form format frame function global group guide handler header "
    "height home host html http image import index info init input install issue item java json label language last layout level library license limit line link list "
    "load local lock main manager master memory menu message method model module month move name network node note number object open option order output page param "
    "parse patch path plan player plugin point policy port post prefix print process product profile project proxy public query queue random range read record region "
    "release remote report request reset result return role root rule sample save schema scope script search section select server service session setting simple size "
    "source space stack stage start state static status step stop store stream string style system table target task team template test text theme thread time title "
    "tool tree true type unit update upload user utils value vendor version video view web width window word work world write year zone"
).split()
#: Numbers that the forest sees, by name.
FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "changes", "distinct", "is_hex", "is_number", "known", "dictionary", "vowels", "longest_run",
    "path_like", "dots", "dashes", "key_before", "harmless_near", "assigned", "quoted",
)
TREES, DEPTH, SEED, LABELLED_ROWS = 20, 6, 7, 4000
#: Forms of findings that ``labelled_findings`` deals out in turn.
FORMS = 16
THRESHOLD = 0.5
MASK = "[SECRET]"


def _around(w: Column) -> Column:
    def one(t: Column, i: Column) -> Column:
        near = lambda a, n: F.array_join(F.slice(w, F.greatest(i + a, F.lit(1)).cast("int"), F.greatest(F.least(F.lit(n), i + a + n - 1), F.lit(0)).cast("int")), " ")
        after = F.array_join(F.slice(w, (i + 2).cast("int"), F.lit(2)), " ")
        digit_or_key = t.rlike("[0-9]") | t.rlike(KEY_WORDS) | F.coalesce(F.get(w, i - 1), F.lit("")).rlike(r"[:=][\"']?$") | F.coalesce(F.get(w, i - 1), F.lit("")).rlike(KEY_WORDS)
        return F.when(digit_or_key & (F.length(t) >= 6), F.struct(i.alias("place"), t.alias("token"), near(-1, 2).alias("before"), after.alias("after")))

    return F.transform(w, one)


def _of_token(t: Column) -> Column:
    """The candidates of one token: place, secret, path (what stands before it in its token), before, after."""
    shaped = F.regexp_extract_all(t["token"], F.lit(CANDIDATE), F.lit(0))
    # What is assigned must end in this token, so that the tokens before don't give it once more.
    assigned = F.filter(F.regexp_extract_all(F.concat_ws(" ", t["before"], t["token"]), F.lit(ASSIGNED), F.lit(1)), lambda s: t["token"].contains(s))
    path = lambda s: F.call_function("substring_index", t["token"], s, F.lit(1))
    one = lambda s: F.struct(t["place"].alias("place"), s.alias("secret"), path(s).alias("path"), t["before"].alias("before"), t["after"].alias("after"))
    return F.transform(F.array_distinct(F.concat(shaped, assigned)), one)


def candidates(text: Column) -> Column:
    """All candidates of a text, in an array; null and empty texts have none.

    A text is cut into blank-separated tokens only if a candidate stands in it, by one pass of the pattern.
    """
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    # The words are bound by a lambda, or they would be cut anew for every token.
    found = F.flatten(F.transform(F.array_compact(F.flatten(F.transform(F.array(words), _around))), _of_token))
    return F.when(text.rlike(f"{CANDIDATE}|{ASSIGNED}"), found)


def _share(c: Column, drop: str) -> Column:
    return 1 - F.length(F.translate(c, drop, "")) / F.length(c)


def feature_columns(s: Column, path: Column, before: Column, after: Column) -> list[Column]:
    """The columns named in FEATURES."""
    low = F.lower(s)
    letters = F.regexp_replace(low, "[^a-z]", "")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A"), "[^A-Za-z0-9]+", "-")
    near = F.concat_ws(" ", before, path, after)
    kinds = {
        "length": F.length(s),
        "digits": _share(s, "0123456789"),
        "uppers": _share(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "lowers": _share(s, "abcdefghijklmnopqrstuvwxyz"),
        "marks": F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")) / F.length(s),
        "changes": F.length(runs) / F.length(s),
        "distinct": F.size(F.array_distinct(F.split(s, ""))) / F.length(s),
        "is_hex": s.rlike("^([0-9a-f]{12,}|[0-9A-F]{12,})$"),
        "is_number": s.rlike("^[0-9.+-]+$"),
        "known": s.rlike(KNOWN),
        "dictionary": 1 - F.length(F.regexp_replace(letters, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / F.greatest(F.length(letters), F.lit(1)),
        "vowels": 1 - F.length(F.translate(letters, "aeiou", "")) / F.greatest(F.length(letters), F.lit(1)),
        "longest_run": F.array_max(F.transform(F.split(low, "[^a-z]+"), lambda w: F.length(w))) / F.length(s),
        "path_like": s.rlike("/.*[/.]") | path.rlike("[/\\\\]$"),
        "dots": F.length(s) - F.length(F.translate(s, ".", "")),
        "dashes": F.length(s) - F.length(F.translate(s, "-_", "")),
        "key_before": F.concat_ws(" ", before, path).rlike(KEY_WORDS),
        "harmless_near": near.rlike(HARMLESS_WORDS) | low.rlike("example|sample|dummy|changeme|xxxx|your"),
        "assigned": F.concat_ws(" ", before, path).rlike(r"[:=]\s*[\"']?$"),
        "quoted": path.rlike("[\"']$"),
    }
    return [F.coalesce(kinds[n].cast("double"), F.lit(0.0)).alias(n) for n in FEATURES]


def features(df: DataFrame) -> DataFrame:
    """All columns and those named in FEATURES, of secret, path, before and after."""
    return df.select("*", *feature_columns(*map(F.col, ("secret", "path", "before", "after"))))


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """Findings with a label, made by rule: token, before, after, secret, path, label (1: a secret).

    Half are keys of the usual forms in the usual places, half are what scanners mistake for keys: digests after commit
    or checksum, identifiers, UUIDs, paths, links, versions, numbers, placeholders and long words with a digit.
    """
    hex_, n = F.sha2(F.col("id").cast("string"), 256), F.col("id")
    base64 = F.translate(F.base64(F.unhex(hex_)), "=", "")
    upper = F.upper(F.translate(F.sha2(F.concat(n.cast("string"), F.lit("k")), 256), "0123456789abcdef", "QWERTYZXCV23N7ML"))
    word = lambda k: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(n, F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    plain = lambda k: F.translate(F.substring(F.sha2(F.concat(n.cast("string"), F.lit(k)), 256), 1, 7), "0123456789abcdef", "etaoinshrdlueioa")
    prose = lambda k: F.concat_ws(" ", plain(k), plain(f"{k}+"))
    key = F.element_at(F.array(*map(F.lit, ("password", "token", "secret", "api_key", "auth_token", "PASSWORD", "access_key"))), (n % 7 + 1).cast("int"))
    number = F.conv(F.substring(hex_, 1, 14), 16, 10)
    forms = [
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.lit(""), prose("a"), prose("b")),
        (1, F.substring(hex_, 1, 20), F.concat(key, F.lit("=")), prose("a"), prose("b")),
        (1, F.substring(hex_, 1, 40), F.lit('"'), F.concat(key, F.lit(" =")), prose("b")),
        (1, F.substring(base64, 1, 32), F.lit("'"), F.concat(key, F.lit(":")), prose("b")),
        (1, F.concat(F.lit("ghp_"), F.substring(base64, 1, 36)), F.lit(""), prose("a"), prose("b")),
        (1, F.concat(F.lit("sk-"), F.substring(base64, 1, 40)), F.concat(key, F.lit("=")), prose("a"), prose("b")),
        (1, F.substring(base64, 1, 12), F.concat(key, F.lit("=")), prose("a"), prose("b")),
        (1, F.substring(hex_, 1, 16), F.concat(key, F.lit(":")), prose("a"), prose("b")),
        (0, F.substring(hex_, 1, 40), F.lit(""), F.element_at(F.array(*map(F.lit, ("in commit", "the commit", "sha1 checksum", "its digest", "md5 is"))), (n % 5 + 1).cast("int")), prose("b")),
        (0, F.concat_ws("-", F.substring(hex_, 1, 8), F.substring(hex_, 9, 4), F.substring(hex_, 13, 4), F.substring(hex_, 17, 4), F.substring(hex_, 21, 12)), F.lit(""), prose("a"), prose("b")),
        (0, F.concat_ws("/", word(1), word(2), F.concat(word(3), (n % 90).cast("string"), F.lit(".py"))), F.lit("/"), prose("a"), prose("b")),
        (0, F.concat_ws("_", word(1), word(2), (n % 900).cast("string")), F.lit(""), prose("a"), prose("b")),
        (0, F.substring(number, 1, 16), F.lit(""), prose("a"), prose("b")),
        (0, F.concat(plain("x"), plain("y"), (n % 10).cast("string")), F.lit(""), prose("a"), prose("b")),
        (0, F.concat(word(1), F.lit("-your-key-"), (n % 99).cast("string")), F.concat(key, F.lit("=")), prose("a"), F.lit("for example")),
        (0, F.concat(F.lit("www."), word(1), (n % 9).cast("string"), F.lit(".example.com/"), word(2)), F.lit("http://"), prose("a"), prose("b")),
    ]
    pick = F.pmod(n, F.lit(FORMS))
    one = lambda i: functools.reduce(lambda rest, kf: F.when(pick == kf[0], F.lit(kf[1][i]) if i == 0 else kf[1][i]).otherwise(rest), enumerate(forms[1:], 1), F.lit(forms[0][0]) if i == 0 else forms[0][i])
    made = spark.range(0, rows, 1, 1).select("id", one(0).cast("double").alias("label"), one(1).alias("secret"), one(2).alias("path"), one(3).alias("before"), one(4).alias("after"))
    return made.withColumn("token", F.concat("path", "secret"))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, rows: int = LABELLED_ROWS) -> str:
    """The forest over ``labelled`` (secret, path, before, after, label), of at most ``rows`` findings, as a SQL expression over FEATURES."""
    seen = features(labelled.where("secret IS NOT NULL AND length(secret) > 0 AND label IN (0, 1)")).select(*FEATURES, "label").limit(rows).repartition(1)
    if len(kinds := [r[0] for r in seen.select("label").distinct().collect()]) < 2:
        return f"{float(kinds[0]) if kinds else 0.0}D"
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(seen).select("x", "label")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(data)

    def sql(node) -> str:
        if node.subtreeDepth() == 0:
            stats = node.impurityStats().stats()
            return f"{stats[1] / (stats[0] + stats[1])!r}D"
        split = node.split()
        return f"CASE WHEN {FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {sql(node.leftChild())} ELSE {sql(node.rightChild())} END"

    return "(" + " + ".join(sql(t._java_obj.rootNode()) for t in model.trees) + f") / {trees}D"


def _accepted(df: DataFrame, forest: str | None, text_col: str, threshold: float) -> DataFrame:
    """``df`` and __found: place, secret and score of what the forest accepts in each row, parts of longer secrets too."""
    forest = forest or train(labelled_findings(df.sparkSession))
    seen = lambda c: F.struct(c["place"].alias("place"), c["secret"].alias("secret"), *feature_columns(c["secret"], c["path"], c["before"], c["after"]))
    of = re.sub(r"\b(" + "|".join(FEATURES) + r")\b", r"c.\1", forest)
    scored = F.transform(F.col("__seen"), lambda c: F.struct(c["place"].alias("place"), c["secret"].alias("secret")))
    with_seen = df.withColumn("__seen", F.transform(candidates(F.col(text_col)), seen))
    scores = with_seen.withColumn("__scores", F.expr(f"transform(__seen, c -> {of})"))
    both = scores.withColumn("__found", F.zip_with(scored, F.col("__scores"), lambda c, p: F.struct(c["place"].alias("place"), c["secret"].alias("secret"), p.alias("score"))))
    return both.withColumn("__found", F.filter("__found", lambda c: c["score"] >= threshold)).drop("__seen", "__scores")


def findings(df: DataFrame, forest: str | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, place, secret, score: a row for each secret of each row of ``df``, place being its token's number.

    Null and empty texts have none; repeated rows give their secrets again; rows without id keep a null id; an empty
    table gives none; other columns play no part. ``forest`` is what ``train`` gave; by default it is trained on
    ``labelled_findings``.
    """
    scored = _accepted(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), forest, "text", threshold)
    # The longest of a token stands for those inside it; one inside a value that the forest rejects stays.
    whole = lambda c: ~F.exists("__found", lambda s: (s["place"] == c["place"]) & (F.length(s["secret"]) > F.length(c["secret"])) & s["secret"].contains(c["secret"]))
    return scored.select(F.col("id").alias(id_col), F.inline(F.filter("__found", whole)))


def redact(df: DataFrame, forest: str | None = None, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``df`` with every secret in its texts masked; all rows and columns stay, as each row is worked on by itself.

    Null texts stay null. Columns are renamed meanwhile, so none clashes.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    text = f"c{df.columns.index(text_col)}"
    scored = _accepted(plain, forest, text, THRESHOLD)
    # Longer secrets go first, as one may be a part of another.
    found = F.reverse(F.array_sort(F.array_distinct(F.transform("__found", lambda c: F.struct(F.length(c["secret"]).alias("n"), c["secret"].alias("secret"))))))
    none = F.array().cast("array<struct<n: int, secret: string>>")
    masked = F.aggregate(F.coalesce(found, none), F.col(text), lambda t, s: F.replace(t, s["secret"], F.lit(mask)))
    return scored.withColumn(text, masked).drop("__found").toDF(*df.columns)
