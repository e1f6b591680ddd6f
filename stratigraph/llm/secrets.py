"""Secret scan with a random forest that removes false positives, in DataFrame and JVM operations only.

Candidates are all runs of 16 or more key characters of all tokens that hold a digit or are assigned to a name (by =
or :). Their length, character
transitions, dictionary coverage, path marks and neighbouring words are numbers computed by SQL functions; a random
forest trained on labelled findings tells secrets from card numbers, digests, paths, identifiers and placeholders.
Labelled findings are a table ``(before, token, after, secret)``; where none is given, ``rule_findings`` makes one
from rules. Secrets themselves are never returned, only their first characters and a digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A candidate's run of characters; words before and after that are looked at.
RUN, NEAR = r"[A-Za-z0-9_+/=\-]{16,}", 3
#: A name and the value it is given, the value in a group.
ASSIGNED = r"^[\"'(]*[A-Za-z_.\-]{2,24}[=:]+[\"']?([A-Za-z0-9_+/=\-]{6,})"
#: Trees, their depth, seed of the forest, rows of each rule, probability from which a finding is a secret.
TREES, DEPTH, SEED, ROWS, THRESHOLD = 24, 8, 11, 160, 0.5
#: Words that make a run readable.
DICTIONARY = "access account address admin article auth author build cache center commit common config content data default demo download example file image index info license link list local login main name news number order page path product project public release report sample search section server service session static store style system table test title token update upload user value version video view web"
#: Words near a candidate that speak for and against a secret.
FOR = r"(?i)(passw|pwd|secret|token|api.?key|access.?key|private|credential|auth|bearer|aws|AKIA)"
AGAINST = r"(?i)(commit|sha-?\d|md5|hash|digest|checksum|etag|uuid|guid|revision|card|visa|iban|order|invoice|example|sample|placeholder|dummy|isbn|serial|id\b)"
FEATURES = ["length", "upper", "lower", "digit", "mark", "switches", "case_switches", "readable_pairs", "distinct", "hex_only", "digits_only", "dictionary", "slashes", "extension", "url", "assigned", "quoted", "key_prefix", "near_for", "near_against", "own_for", "placeholder", "hyphens"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, position, run_number, before, token, after) of each candidate.

    position counts white-space tokens from 0, run_number the runs of a token from 0. A token of several runs is cut:
    each run keeps the marks that quote it, and what lies between it and its neighbours, these included, stands in
    before and after. The first run keeps all that precedes it in the token, the last all that follows. A candidate
    carries ``NEAR`` words of either side, never the text.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+", -1).alias("words"))
    word = lambda at: F.get("words", at)
    joined = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda at: (F.char_length(word(at)) >= 16) & word(at).rlike(RUN))
    found = F.transform(places, lambda at: F.struct(
        at.cast("long").alias("position"),
        word(at).alias("whole"),
        F.when(at > 0, joined(F.greatest(at - NEAR, F.lit(0)) + 1, F.least(at, F.lit(NEAR)))).otherwise("").alias("words_before"),
        joined(at + 2, F.lit(NEAR)).alias("words_after"),
    ))
    runs = words.select("doc_id", F.inline(found)).withColumns({"runs": F.regexp_extract_all("whole", F.lit(RUN), F.lit(0)), "gaps": F.split("whole", RUN, -1)})
    rows = runs.select("doc_id", "position", "words_before", "words_after", "runs", "gaps", F.posexplode("runs").alias("run_number", "value"))
    k = F.col("run_number")
    first, last = k == 0, k == F.size("runs") - 1
    left, right = F.get("gaps", k), F.get("gaps", k + 1)
    opening, closing = F.regexp_extract(left, r"[\"'(]*$", 0), F.regexp_extract(right, r"^[\"')]*", 0)
    before = F.when(first, F.col("words_before")).otherwise(F.concat(F.get("runs", k - 1), F.substr(left, F.lit(1), F.char_length(left) - F.char_length(opening))))
    after = F.when(last, F.col("words_after")).otherwise(F.concat(F.substr(right, F.char_length(closing) + 1), F.get("runs", k + 1)))
    token = F.concat(F.when(first, left).otherwise(opening), "value", F.when(last, right).otherwise(closing))
    rows = rows.select("doc_id", "position", F.col("run_number").cast("long").alias("run_number"), before.alias("before"), token.alias("token"), after.alias("after"), "value")
    return rows.where(F.col("value").rlike("[0-9]") | F.col("before").rlike(r"[=:]\s*$") | F.col("token").rlike(ASSIGNED)).drop("value")


def _share(run: Column, pattern: str) -> Column:
    return F.regexp_count(run, F.lit(pattern)) / F.greatest(F.char_length(run), F.lit(1))


def featured(rows: DataFrame) -> DataFrame:
    """``rows`` with the candidate's value as ``run`` and one column per feature."""
    parts = F.regexp_extract("token", RUN, 0)
    assigned = F.regexp_extract("token", ASSIGNED, 1)
    rows = rows.withColumn("run", F.when((assigned != "") & F.endswith(parts, assigned), assigned).otherwise(parts))
    run, low = F.col("run"), F.lower("run")
    left = F.regexp_replace(low, "(" + "|".join(DICTIONARY.split()) + ")", "")
    size = F.greatest(F.char_length(run), F.lit(1))
    number = lambda c: c.cast("double")
    made = {
        "length": number(size),
        "upper": _share(run, "[A-Z]"),
        "lower": _share(run, "[a-z]"),
        "digit": _share(run, "[0-9]"),
        "mark": _share(run, "[^A-Za-z0-9]"),
        "switches": _share(run, "(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"),
        "case_switches": _share(run, "(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "readable_pairs": _share(low, "[bcdfghjklmnpqrstvwxyz][aeiou]"),
        "distinct": number(F.size(F.array_distinct(F.split(run, "")))) / size,
        "hex_only": number(low.rlike("^[0-9a-f]+$").cast("int")),
        "digits_only": number(run.rlike("^[0-9\\-]+$").cast("int")),
        "dictionary": (size - F.char_length(left)) / size,
        "slashes": number(F.regexp_count("token", F.lit("/"))),
        "extension": number(F.col("token").rlike(r"\.(png|jpe?g|gif|svg|html?|css|js|py|java|txt|pdf|zip|gz|json|xml|md)\b").cast("int")),
        "url": number(F.col("token").rlike(r"(?i)(https?:|www\.|\.com|\.org|\.net)").cast("int")),
        "assigned": number(((assigned != "") | F.col("before").rlike(r"[=:]\s*$")).cast("int")),
        "quoted": number(F.col("token").rlike("[\"']").cast("int")),
        "key_prefix": number(run.rlike("^(AKIA|ASIA|gh[pousr]_|xox[abp]-|sk_live|sk-|AIza|glpat-)").cast("int")),
        "near_for": number(F.col("before").rlike(FOR).cast("int")),
        "near_against": number((F.col("before").rlike(AGAINST) | F.col("after").rlike(AGAINST)).cast("int")),
        "own_for": number(F.col("token").rlike(FOR).cast("int")),
        "placeholder": number(run.rlike(r"(?i)(xxxx|0000|1234|abcd|example|sample|placeholder|(.)\2{4})").cast("int")),
        "hyphens": number(F.regexp_count(run, F.lit("-"))),
    }
    return rows.withColumns(made)


def rule_findings(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """Labelled findings from rules: ``rows`` of each of the kinds below, from hashes of their numbers alone."""
    hexed = lambda n: f"substr(sha2(concat('{n}-', id, '-', kind), 256), 1, {n})"
    base = "substr(translate(base64(unhex(sha2(concat('b-', id, '-', kind), 256))), '=', 'x'), 1, 40)"
    caps = "substr(upper(translate(base64(unhex(sha2(concat('c-', id, '-', kind), 256))), '+/=', '2Q7')), 3, 16)"
    digits = "lpad(cast(pmod(xxhash64(id, kind), 10000000000000000) as string), 16, '4')"
    word = "element_at(split('alpha river stone the of report and with module under image value', ' '), cast(pmod(xxhash64(id, 'w'), 12) + 1 as int))"
    mixed = "initcap(substr(translate(lower(base64(unhex(sha2(concat('m-', id, '-', kind), 256)))), '+/=0123456789', ''), 1, 9))"
    mixed_too = "initcap(substr(translate(lower(base64(unhex(sha2(concat('n-', id, '-', kind), 256)))), '+/=0123456789', ''), 1, 9))"
    kinds = [
        ("", f"concat('AKIA', {caps})", "", 1),
        ("aws key =", f"concat('\"AKIA', {caps}, '\"')", "", 1),
        ("", f"concat('password=', {hexed(18)})", "", 1),
        ("", f"concat('passwd:', {hexed(20)})", "", 1),
        ("token =", f"concat('\"', {hexed(40)}, '\"')", "", 1),
        ("secret :", f"concat('\"', {base}, '\"')", "", 1),
        ("api_key =", f"concat('\\'', {hexed(32)}, '\\'')", "", 1),
        ("", f"concat('secret_key=', {base})", "", 1),
        ("", f"concat('ghp_', substr({base}, 1, 36))", "", 1),
        ("Authorization: Bearer", base, "", 1),
        ("", f"concat('password=', substr({base}, 1, 11))", "", 1),
        ("password =", f"concat({mixed}, {mixed_too})", "", 1),
        ("db_password:", f"concat('\"', {mixed}, {mixed_too}, '\"')", "", 1),
        ("", digits, "", 0),
        ("card", digits, "", 0),
        ("number", f"concat(substr({digits}, 1, 8), '-', substr({digits}, 3, 10))", "", 0),
        ("commit", hexed(40), "", 0),
        ("md5", hexed(32), "", 0),
        ("sha256:", hexed(64), "", 0),
        ("uuid", f"concat_ws('-', {hexed(8)}, substr({hexed(9)}, 1, 4), substr({hexed(10)}, 1, 4), substr({hexed(11)}, 1, 4), {hexed(12)})", "", 0),
        ("see", f"concat('/images/', {word}, '/archive/', pmod(id, 2030), '/section-', pmod(id, 97), '/index.html')", "", 0),
        ("", f"concat('https://www.', {word}, '.example.com/article/', pmod(id * 7919, 1000003), '?page=2')", "", 0),
        ("title:", f"concat({word}, '-', {word}, '-and-the-', {word}, '-page')", "", 0),
        ("see:", f"concat('class=', {word}, '-section-', {word}, '-list')", "", 0),
        ("file", f"concat({word}, '_default_config_version_', pmod(id, 31), '.json')", "", 0),
        ("password =", "concat('\"xxxxxxxxxxxx', lpad(pmod(id, 10000), 4, '0'), '\"')", "", 0),
        ("example key", "concat('AKIAEXAMPLE', lpad(pmod(id, 1000000000), 9, '0'))", "", 0),
        ("", f"concat('id_', {word}, '_user_session_', pmod(id * 31, 9973))", "", 0),
        ("", f"concat('order-number-', pmod(id * 104729, 100000007), '-', {word})", "", 0),
    ]
    numbered = spark.range(rows)
    made = [numbered.selectExpr(f"'{k}' AS kind", "id").selectExpr(f"concat_ws(' ', {word}, '{b}') AS before", f"{t} AS token", f"concat('{a}', {word}) AS after", f"{s}.0D AS secret") for k, (b, t, a, s) in enumerate(kinds)]
    return reduce(DataFrame.unionByName, made)


def train(findings: DataFrame) -> PipelineModel:
    """Forest over the features of ``findings (before, token, after, secret)``; rows with nulls are left out."""
    rows = featured(findings.dropna(subset=["before", "token", "after", "secret"])).select(*FEATURES, F.col("secret").cast("double").alias("secret"))
    joined = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return PipelineModel([joined, forest.fit(joined.transform(rows.coalesce(1)))])


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Candidates with their verdict: (doc_id, position, run_number, kind, shown, value_sha256, length, score, is_secret).

    One row per candidate. ``shown`` is its first four characters, value_sha256 the digest of the whole value, kind
    a name by form. Null and empty texts have no candidate, repeated rows give their findings each, a null doc_id
    stays null, an empty table gives an empty result; other columns are not looked at.
    """
    model = train(rule_findings(docs.sparkSession) if findings is None else findings)
    scored = model.transform(featured(candidates(docs)))
    kind = F.when(F.col("key_prefix") == 1, "key id").when(F.col("digits_only") == 1, "number").when(F.col("hex_only") == 1, "hex").when(F.col("slashes") > 0, "path").otherwise("mixed")
    score = F.element_at(vector_to_array("probability"), 2)
    return scored.select(
        "doc_id",
        "position",
        "run_number",
        kind.alias("kind"),
        F.substr("run", F.lit(1), F.lit(4)).alias("shown"),
        F.sha2("run", 256).alias("value_sha256"),
        F.char_length("run").cast("long").alias("length"),
        score.alias("score"),
        (score >= THRESHOLD).alias("is_secret"),
    )
