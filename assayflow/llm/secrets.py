"""Secret scans: regex candidates, and a random forest over each candidate and its surroundings against false alarms.

All of it is DataFrame functions and Spark's own random forest; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_sum

_NAMES = "token|secret|passwd|password|apikey|api_key|api-key"
#: What names a secret, with any words that follow in the name, and assigns to it. A later name in a run starts anew, which keeps the search linear.
_SIGN = rf"(?i:(?:{_NAMES})(?:(?!{_NAMES})[A-Za-z0-9_-])*+[\"']?[ \t]*+[:=][ \t]*+)"
ASSIGNED = _SIGN + "[\"']?"
#: A private key from its first line to its last, or to the next dashes or the end if that is missing.
_KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----(?:(?!-----)[\s\S])*+(?:-----END [A-Z0-9 ]*-----)?"
#: A key block, what is assigned to a secret's name (a quoted value to its own quote on that line, any other to white
#: space or a quote), or 16 or more token characters with a digit among them. Of any length.
CANDIDATE = _KEY_BLOCK + "|" + _SIGN + r"(?:\"[^\"\r\n]{8,}+(?=\")|'[^'\r\n]{8,}+(?=')|[\"']?[^\s\"']{8,}+)|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+"
#: What every candidate has; texts without it are passed over before the slower search.
NEEDED = "[0-9:=]|PRIVATE KEY"
BEFORE, AFTER = 48, 24
TREES, DEPTH, SEED = 32, 8, 17
THRESHOLD = 0.5
FINDINGS = 8_192
#: Uses in the whole corpus from which a word counts as one of its dictionary.
COMMON = 20
#: Places summed at once (see _sums_before).
_SUMMED = 512

# Words by which secrets and harmless look-alikes are named, words of identifiers, and beginnings of tokens.
_SECRET_WORDS = "token|secret|passw|passwd|pwd|api.?key|access.?key|private|credential|auth|bearer|client.?id"
_PLAIN_WORDS = "commit|sha|md5|hash|uuid|guid|checksum|etag|digest|revision|version|build|card|iban|phone|order|invoice|image|ref|page"
CODE_WORDS = ("test", "example", "sample", "default", "config", "value", "index", "file", "list", "user", "name", "data", "image", "page", "path", "version", "build", "release", "http", "www", "html")
_TOKEN_STARTS = "^(?:AKIA|ASIA|gh[opusr]_|github_pat_|sk_|pk_|xox[abprs]-|eyJ|AIza|-----BEGIN)"
FEATURES = ["length", "transitions", "distinct_share", "digit_share", "upper_share", "hex_only", "token_start", "dictionary_share", "vowel_share", "secret_before", "plain_before", "assigned", "quoted", "path_secret", "path_test"]

_RUNS = "[A-Z]?[a-z]{2,}|[A-Z]{3,}"
_WORDS = "(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,}(?![A-Za-z0-9+/_=-])"


def _sums_before(numbers: str) -> tuple[Column, Column]:
    """Two steps to the sum of the numbers before each of an array: of blocks (a column `blocks` is made of it), and all.

    Appending to an array copies it, so sums are made in blocks, and then of blocks: near to linear for any length.
    """
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
    step = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before"))
    blocks = F.transform(F.sequence(F.lit(1), F.size(numbers), F.lit(_SUMMED)), lambda at: F.aggregate(F.slice(numbers, at, F.lit(_SUMMED)), empty, step))
    ahead = F.aggregate(F.transform("blocks", lambda b: b["sum"]), empty, step)["before"]
    return blocks, F.flatten(F.zip_with("blocks", ahead, lambda b, more: F.transform(b["before"], lambda v: v + more)))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row per candidate of each whole text: doc_id, text_sum, start (in characters), at (in bytes), candidate, before, after, path."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col else F.lit("")
    some = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_sum"), path.alias("path"), text.alias("text")).filter(F.col("text").rlike(NEEDED))
    cut = some.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).filter(F.size("found") > 0)
    cut = cut.withColumn("between", F.split("text", CANDIDATE, -1)).drop("text")
    for name, size in (("start", F.length), ("at", F.octet_length)):
        cut = cut.withColumn("steps", F.transform("found", lambda w, k: (size(w) + size(F.get("between", k))).cast("long")))  # noqa: B023
        blocks, ahead = _sums_before("steps")
        cut = cut.withColumn("blocks", blocks).withColumn(f"{name}s", ahead)
    piece = lambda w, k: F.struct(
        (F.get("starts", k) + F.length(F.get("between", k))).alias("start"), (F.get("ats", k) + F.octet_length(F.get("between", k))).alias("at"),
        w.alias("whole"), F.right(F.get("between", k), F.lit(BEFORE)).alias("before"), F.left(F.get("between", k + 1), F.lit(AFTER)).alias("after"),
    )
    rows = cut.select("doc_id", "text_sum", "path", F.explode(F.transform("found", piece)).alias("p")).select("doc_id", "text_sum", "path", "p.*")
    rows = rows.withColumn("name", F.regexp_extract("whole", "^(" + ASSIGNED + r")[\s\S]{8,}+$", 1))
    n = F.length("name")
    return rows.select(
        "doc_id", "text_sum", (F.col("start") + n).alias("start"), (F.col("at") + F.octet_length("name")).alias("at"), F.substring("whole", n + 1, F.length("whole")).alias("candidate"),
        F.right(F.concat("before", "name"), F.lit(BEFORE)).alias("before"), "after", "path",
    )


def dictionary(docs: DataFrame, text_col: str = "text", common: int = COMMON) -> DataFrame:
    """word: what is used as a word of its own at least `common` times in all texts, and words of identifiers."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(_WORDS), F.lit(0))).alias("word")).groupBy(F.lower("word").alias("word")).count()
    code = docs.sparkSession.createDataFrame([(w,) for w in CODE_WORDS], "word string")
    return words.filter(F.col("count") >= common).select("word").unionByName(code).distinct()


def with_dictionary(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows (candidate, ...) with dictionary_share: the characters of a candidate in words of the dictionary.

    A candidate's words are its runs of letters, cut where capitals begin. Each different candidate is looked up once.
    """
    return _looked_up(rows.withColumns(_veil()), words).drop("runs", "size")


def _veil() -> dict[str, Column]:
    """What is known of a candidate without its text: its hash, its size, and hashes and lengths of its words."""
    run = lambda w: F.struct(F.xxhash64(F.lower(w)).alias("word"), F.length(w).alias("n"))
    return {"candidate_sha256": F.sha2("candidate", 256), "size": F.length("candidate"), "runs": F.transform(F.regexp_extract_all("candidate", F.lit(_RUNS), F.lit(0)), run)}


def _looked_up(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows (candidate_sha256, size, runs) with dictionary_share; no candidate's text is shuffled."""
    different = rows.groupBy("candidate_sha256").agg(F.first("runs").alias("runs"), F.first("size").alias("size"))
    hashes = words.select(F.xxhash64("word").alias("word")).distinct()
    known = different.select("candidate_sha256", "size", F.explode("runs").alias("run")).select("candidate_sha256", "size", "run.*").join(hashes, "word")
    shares = known.groupBy("candidate_sha256").agg((F.sum("n") / F.max("size")).alias("share"))
    return rows.join(shares, "candidate_sha256", "left").withColumn("dictionary_share", F.coalesce("share", F.lit(0.0))).drop("share")


def with_features(rows: DataFrame, looked_up: bool = True) -> DataFrame:
    """rows (candidate, before, after, path, dictionary_share) with the columns of FEATURES; not looked up yet, all but dictionary_share."""
    c, low = F.col("candidate"), F.lower(F.col("candidate"))
    n = F.greatest(F.length(c), F.lit(1))
    share = lambda pattern, of: (n - F.length(F.regexp_replace(of, pattern, ""))) / n
    kinds = F.translate(c, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 5)
    flag = lambda col: col.cast("double")
    before, path = F.lower("before"), F.lower("path")
    made = {
        "length": F.length(c), "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)), "digit_share": share("[0-9]", c), "upper_share": share("[A-Z]", c),
        "hex_only": flag(c.rlike("^(?:[0-9a-f-]+|[0-9A-F-]+)$")), "token_start": flag(c.rlike(_TOKEN_STARTS)), "vowel_share": share("[aeiou]", low),
        "secret_before": flag(before.rlike(_SECRET_WORDS)), "plain_before": flag(before.rlike(_PLAIN_WORDS)), "assigned": flag(before.rlike(r"[:=]\s*[\"']?$")),
        "quoted": flag(before.rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")), "path_secret": flag(path.rlike(r"[.]env|secret|credential|[.]pem|config|[.]ya?ml")),
        "path_test": flag(path.rlike("test|example|docs?/|fixture|[.]md")), "dictionary_share": F.col("dictionary_share"),
    }
    return rows.withColumns({f: made[f].cast("double") for f in FEATURES if looked_up or f != "dictionary_share"})


# How labelled findings are made. Kinds of candidate by label, and what stands before them.
_NAMED = ("token = \"", "api_key=", "secret: ", "password: '", "access_key ", "export AUTH_TOKEN=", "client_secret\": \"", "PRIVATE_TOKEN := ", "bearer ", "credentials ")
_NEUTRAL = ("", "see ", "value ", "id=", "then ", "set to ", "(", "is: ", "header ", "got \"")
_HARMLESS = ("commit ", "sha1 ", "uuid: ", "card ", "md5=", "image/", "build ", "order ", "page ", "checksum: \"", "etag=\"", "ref ", "version ", "invoice ")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Made findings with a label, in the columns of findings(): secrets in use, and what only looks like one.

    Kind, what stands before and path are drawn on their own, so no one of them gives a label away: both labels have
    hexadecimal strings and base64, three of ten secrets stand behind neutral or harmless words, and two of ten
    look-alikes behind a secret's name. Any table of these columns does instead.
    """
    ids = spark.range(n).withColumn("hex", F.concat(F.sha2(F.col("id").cast("string"), 256), F.sha2(F.concat(F.lit("b"), "id"), 256)))
    ids = ids.withColumn("b64", F.regexp_replace(F.base64(F.unhex("hex")), "=", ""))
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    pick = lambda k, of: F.element_at(F.array(*[F.lit(x) for x in of]), (draw(k, len(of)) + 1).cast("int"))
    hexa, b64 = F.col("hex"), F.col("b64")
    cut = lambda of, k, *sizes: F.substring(of, F.lit(1), pick(k, sizes))
    number = F.substring(F.translate(hexa, "abcdef", "402683"), F.lit(1), pick(20, (13, 16, 16, 19)))
    uuid = F.concat_ws("-", *[F.substring("hex", a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    words = F.concat_ws("-", pick(1, CODE_WORDS), pick(2, CODE_WORDS), pick(3, CODE_WORDS), F.substring("hex", 1, 2))
    camel = F.concat(F.initcap(pick(4, CODE_WORDS)), F.initcap(pick(5, CODE_WORDS)), F.initcap(pick(6, CODE_WORDS)), F.substring("hex", 1, 1), F.lit("7"))
    stamp = F.concat(F.lit("2024-0"), (draw(7, 9) + 1).cast("string"), F.lit("-1"), draw(8, 9).cast("string"), F.lit("_120000-"), F.substring("hex", 1, 4))
    pad = F.concat(F.repeat(pick(9, ("x", "0", "a", "-", "=")), (draw(10, 30) + 16).cast("int")), F.lit("0"))
    block = F.concat(F.lit("-----BEGIN "), pick(11, ("", "RSA ", "EC ", "OPENSSH ")), F.lit("PRIVATE KEY-----\n"), F.repeat(F.concat(F.substring("b64", 1, 64), F.lit("\n")), (draw(12, 20) + 2).cast("int")), F.lit("-----END PRIVATE KEY-----"))
    secrets = [
        cut(hexa, 30, 32, 40, 64), cut(b64, 31, 24, 32, 40, 43, 64, 86), F.concat(F.lit("AKIA"), F.upper(F.substring("hex", 1, 16))), F.concat(F.lit("ghp_"), F.substring("b64", 1, 36)),
        cut(b64, 32, 10, 12, 16), F.concat(F.lit("eyJ"), F.substring("b64", 3, 60)), F.upper(cut(hexa, 33, 32, 40)), block,
    ]
    plain = [cut(hexa, 34, 32, 40, 64), uuid, number, words, pad, camel, stamp, F.concat_ws("/", pick(13, CODE_WORDS), pick(14, CODE_WORDS), F.substring("hex", 1, 6)), cut(b64, 35, 86, 120, 160), number]
    choose = lambda k, of: F.get(F.array(*of), draw(k, len(of)).cast("int"))
    secret, luck = F.pmod("id", F.lit(2)) == 0, draw(40, 10)
    before = F.when(secret, F.when(luck < 7, pick(41, _NAMED)).when(luck < 9, pick(42, _NEUTRAL)).otherwise(pick(43, _HARMLESS)))
    before = before.otherwise(F.when(luck < 5, pick(43, _HARMLESS)).when(luck < 8, pick(42, _NEUTRAL)).otherwise(pick(41, _NAMED)))
    candidate = F.when(secret, choose(44, secrets)).otherwise(choose(45, plain))
    path = F.when(draw(46, 10) < 6, pick(47, ("", "notes", "page.html", "src0"))).when(secret, pick(48, ("deploy/.env", "config.yml", "id.pem", "test/a.py"))).otherwise(pick(49, ("docs/read.md", "tests/a.py", "example.txt", "config.yml")))
    rows = ids.select(F.col("id").alias("doc_id"), candidate.alias("candidate"), F.concat(pick(50, ("the ", "in ", "", "a ")), before).alias("before"), path.alias("path"), secret.cast("double").alias("label"))
    quote = F.when(F.col("before").rlike("[\"']$"), F.right("before", F.lit(1))).otherwise(F.lit(" "))
    return rows.withColumn("after", quote).withColumn("start", F.length("before").cast("long")).withColumn("at", F.col("start")).withColumn("text_sum", F.lit(0).cast("long"))


def fit(labelled: DataFrame, words: DataFrame | None = None) -> PipelineModel:
    """A forest on labelled findings (see labelled_findings for the columns); words is a dictionary()."""
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features_of_candidate")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features_of_candidate", probabilityCol="odds", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    words = labelled.sparkSession.createDataFrame([(w,) for w in CODE_WORDS], "word string") if words is None else words
    rows = materialize(with_features(with_dictionary(labelled, words)).select("label", *FEATURES), "labelled-findings")
    return PipelineModel([assemble, forest.fit(assemble.transform(rows))])


def scan(docs: DataFrame, model: PipelineModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD, words: DataFrame | None = None) -> DataFrame:
    """A row per candidate: doc_id, start, length, candidate_sha256, score (0 to 1), is_secret (score >= threshold).

    Also text_sum, at and bytes: a hash of the text and the candidate's place in its UTF-8 bytes, for redact(). Whole
    texts are scanned; the dictionary is of the words of all texts unless given. The secret itself is not passed on, nor
    written or shuffled on the way: only hashes, sizes and features leave the task that reads its text.
    Null and empty texts have no rows; a null path is empty; null ids are kept; repeated rows repeat their findings;
    an empty table gives no rows; other columns are ignored.
    """
    seen = with_features(findings(docs, id_col, text_col, path_col), looked_up=False).withColumns(_veil() | {"bytes": F.octet_length("candidate").cast("long")})
    found = materialize(seen.select("doc_id", "text_sum", "start", "at", "bytes", "size", "candidate_sha256", "runs", *[f for f in FEATURES if f != "dictionary_share"]), "findings")
    words = materialize(dictionary(docs, text_col), "dictionary") if words is None else words
    scored = model.transform(_looked_up(found, words))
    score: Column = vector_to_array("odds")[1]
    return scored.select(
        "doc_id", "start", F.col("size").cast("long").alias("length"), "candidate_sha256", score.alias("score"), (score >= threshold).alias("is_secret"), "text_sum", "at", "bytes",
    )


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs (doc_id, text, any others) with every found secret of scan() replaced.

    Rows are told apart by id and text. Null texts stay null; rows without a secret stay as they are.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"), text_sum().alias("row_sum"), F.col("text").cast("binary").alias("raw"))
    spans = found.filter("is_secret").groupBy(F.col("doc_id").alias("of"), F.col("text_sum").alias("of_sum")).agg(F.sort_array(F.collect_set(F.struct("at", "bytes"))).alias("spans"))
    joined = rows.join(spans, F.col("row_id").eqNullSafe(F.col("of")) & (F.col("row_sum") == F.col("of_sum")), "left")
    end = lambda s: s["at"] + s["bytes"]
    part = lambda a, b: F.expr("raw").substr((a + 1).cast("int"), (b - a).cast("int")).cast("string")
    zero = F.lit(0).cast("long")
    pieces = F.transform("spans", lambda s, i: F.concat(part(F.when(i > 0, end(F.get("spans", i - 1))).otherwise(zero), s["at"]), F.lit(mark)))
    last = part(end(F.element_at("spans", -1)), F.octet_length("raw"))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.concat(F.array_join(pieces, ""), last))
    return joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
