"""Secret scan with a random forest that removes false positives.

Every run of at least sixteen letters, digits and joining marks is a candidate,
and so is every value assigned to a secret's name, whatever its length and marks.
A forest scores it from its length, character transitions (changes of kind, and
how usual its letter pairs are in ordinary words), dictionary coverage (share of
characters inside common words), path and neighbouring words. It is trained on
labelled findings, a table with the columns of ``findings`` and ``label``;
``known_shapes`` labels findings by shapes whose meaning is certain. Only
DataFrame functions and the DataFrame machine-learning library are used.

What is fitted: letter pairs and common words are counted over all documents; a
word is common from one in ``RAREST`` of all words on. Only the forest has a
sample: at most ``LABELLED`` findings of each label, those with the smallest
hashes. All candidates of all documents are scored.

Defined results: a null text has no candidate; a null path counts as empty; a
text without candidates has no row; repeated rows have repeated findings; with
findings of one label only, every score is that label; without any, 0; an
empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm.shared import shared_folder, stored

CANDIDATE = "[A-Za-z0-9+/_-]{16,}={0,2}"
#: Characters of context kept on either side.
NEAR = 60
#: Characters of a piece of a value.
PIECE = 64
#: A common word is at least one in so many words, so the dictionary has no more than so many, whatever the corpus.
RAREST = 1_000_000
LABELLED = 3000
TREES, DEPTH = 24, 7
#: Words that name a secret, and words of paths that hold examples (fixed values).
NAMING = "key|token|secret|password|passwd|pwd|api|auth|credential|bearer|private|access|sign"
EXAMPLES = "test|example|sample|fixture|mock|doc|spec|demo"
#: A name with a word of NAMING, and the sign that assigns; then the value: what is quoted, or all up to a space.
ASSIGNS = rf"(?i)(?<![\w-])(?=[\w-]*?(?:{NAMING}))[\w-]++[\\\"'`)\]]*+\s*+(?::=|=>|==?|:)\s*+\\*+[\"'`]?+"
ASSIGNED = ASSIGNS + (
    r"((?<=\")[^\"\r\n]++(?=\")|(?<=')[^'\r\n]++(?=')|(?<=`)[^`\r\n]++(?=`)|(?![\"'`]+(?:[\s,;)}\]]|$))\S++)"
)
#: Usual letter pairs have a higher mean than this; an unseen pair counts as rare.
UNSEEN = -9.0

FEATURES = (
    "length", "kind_changes", "digit_share", "capital_share", "different_share", "hex_only", "pair_likelihood", "covered",
    "path_examples", "path_depth", "path_bucket", "names_secret", "assigned", "quoted", "bucket_before", "bucket_after", "distance",
)


def places(texts: DataFrame, pattern: str, group: int) -> DataFrame:
    """What ``pattern`` finds in each text: row, doc_id, path, start, value, before, after. The value ends the match."""
    cut = texts.filter(F.col("text").rlike(pattern)).select(
        "row", "doc_id", "path", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("found"), F.split("text", pattern, -1).alias("between"),
    )
    lead = F.col("number")
    each = cut.select("row", "doc_id", "path", "matches", "between", F.posexplode("found").alias("number", "value")).select(
        "row", "doc_id", "path", "number", "value", F.get("between", lead + 1).alias("next"),
        F.concat(F.get("between", lead), F.expr("left(matches[number], length(matches[number]) - length(value))")).alias("lead"),
    )
    each = each.select(
        "row", "doc_id", "path", "number", "value", F.length("lead").alias("gap"),
        F.right("lead", F.lit(NEAR)).alias("before"), F.left("next", F.lit(NEAR)).alias("after"),
    )
    # Narrow rows of one text; a text is one row of the input, so its findings are bounded.
    so_far = Window.partitionBy("row").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("start", F.sum(F.col("gap") + F.length("value")).over(so_far) - F.length("value")).drop("gap", "number")


def findings(docs: DataFrame, folder: str, path: str = "source") -> DataFrame:
    """Candidates with place and context: finding, doc_id, path, number, start, value, before, after."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), F.col("text").cast("string").alias("text"))
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    runs = places(numbered, CANDIDATE, 0)
    # A value that is a run as a whole is one finding.
    assigned = places(numbered, ASSIGNED, 1).join(runs.select("row", "start", "value"), ["row", "start", "value"], "left_anti")
    in_text = Window.partitionBy("row").orderBy("start", "value")
    placed = runs.unionByName(assigned).withColumn("number", F.row_number().over(in_text) - 1)
    return stored(
        placed.select(F.monotonically_increasing_id().alias("finding"), "doc_id", "path", "number", "start", "value", "before", "after"),
        folder, "findings",
    )


def known_shapes(found: DataFrame) -> DataFrame:
    """Label findings: 1 for issued key shapes and for values with digits assigned to a secret's name, else 0.

    Short assigned values of digits only, or without digits but not one plain word, are not certain: null.
    """
    issued = F.col("value").rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^xox[abpr]-")
    named = F.lower("before").rlike(f"({NAMING})[a-z_]*\\W{{0,3}}[=:]\\W{{0,3}}$") | F.col("before").rlike(f"{ASSIGNS}$")
    long, digits = F.length("value") >= 16, F.col("value").rlike("[0-9]")
    unsure = named & ~long & ~F.col("value").rlike("^[A-Za-z][a-z]*[.,;:)]?$") & ~(digits & F.col("value").rlike("[^0-9]"))
    return found.withColumn("label", F.when(issued | (named & digits & (long | F.col("value").rlike("[^0-9]"))), 1).when(~unsure, 0))


def ordinary_words(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Log chances of letter pairs, and common words of 3 to 8 letters, from the words of all documents."""
    # Counted in each scan task first, so that a frequent word is one row a task.
    words = stored(
        docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,24}"), F.lit(0))).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("times")),
        folder, "words",
    )
    pair = words.select("times", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))).alias("pair"))
    counted = pair.groupBy("pair").agg(F.sum("times").alias("times"))
    # At most 26 x 26 pairs.
    firsts = Window.partitionBy(F.left("pair", F.lit(1)))
    pairs = counted.select("pair", F.log(F.col("times") / F.sum("times").over(firsts)).alias("chance"))
    total = words.agg(F.sum("times")).first()[0] or 0
    common = words.filter((F.length("word") <= 8) & (F.col("times") * RAREST >= total)).select("word")
    return stored(pairs, folder, "pairs"), stored(common, folder, "common")


def featured(found: DataFrame, pairs: DataFrame, common: DataFrame) -> DataFrame:
    """The findings with all FEATURES."""
    value, size = F.col("value"), F.length("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "."), "[a-z]", "l"), "[A-Z]", "U"), "[0-9]", "9")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / size
    word = lambda text, pattern: F.lower(F.regexp_extract(text, pattern, 1))
    bucket = lambda text, n: F.pmod(F.xxhash64(text), F.lit(n)).cast("double")
    naming = F.regexp_extract(F.lower("before"), f".*(?:{NAMING})(.*)$", 1)
    named = F.lower("before").rlike(NAMING)
    plain = found.select(
        "*", size.cast("double").alias("length"),
        (F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) / size).alias("kind_changes"),
        share("[^0-9]").alias("digit_share"), share("[^A-Z]").alias("capital_share"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64))).alias("different_share"),
        value.rlike("^[0-9a-fA-F]+$").cast("double").alias("hex_only"),
        F.lower("path").rlike(EXAMPLES).cast("double").alias("path_examples"),
        F.size(F.split("path", "/")).cast("double").alias("path_depth"), bucket(F.col("path"), 32).alias("path_bucket"),
        named.cast("double").alias("names_secret"), F.when(named, F.length(naming)).otherwise(NEAR).cast("double").alias("distance"),
        F.col("before").rlike(r"[=:]\W{0,3}$").cast("double").alias("assigned"), F.col("before").rlike("[\"'`]$").cast("double").alias("quoted"),
        bucket(word(F.col("before"), r"(\w+)\W*$"), 64).alias("bucket_before"), bucket(word(F.col("after"), r"^\W*(\w+)"), 64).alias("bucket_after"),
    )
    # A value is cut into short pieces, each with the first characters of the next, so that a long value costs no more a character.
    parts = found.select("finding", size.alias("size"), F.regexp_extract_all(F.lower("value"), F.lit(f".{{1,{PIECE}}}"), F.lit(0)).alias("parts"))
    piece = parts.select("finding", "size", "parts", F.posexplode("parts").alias("at", "part")).select(
        "finding", "size", "at", F.length("part").alias("own"),
        F.concat("part", F.coalesce(F.left(F.get("parts", F.col("at") + 1), F.lit(7)), F.lit(""))).alias("part"),
    )
    spots = piece.select("finding", "size", "at", "part", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("spot"))
    # Both tables are bounded: 676 pairs and RAREST words.
    likely = (
        spots.select("finding", F.col("part").substr(F.col("spot"), F.lit(2)).alias("pair")).filter(F.length("pair") == 2)
        .join(F.broadcast(pairs), "pair", "left")
        .groupBy("finding").agg(F.avg(F.coalesce("chance", F.lit(UNSEEN))).alias("pair_likelihood"))
    )
    covered = (
        spots.select("finding", "size", "at", "part", "spot", F.explode(F.sequence(F.lit(3), F.lit(8))).alias("n"))
        .select("finding", "size", "n", (F.col("at") * PIECE + F.col("spot")).alias("spot"), F.col("part").substr(F.col("spot"), F.col("n")).alias("word"))
        .filter(F.length("word") == F.col("n")).join(F.broadcast(common), "word")
        .groupBy("finding", "size", "spot").agg(F.max("n").alias("n"))
        .select("finding", "size", F.explode(F.sequence("spot", F.col("spot") + F.col("n") - 1)).alias("inside")).distinct()
        .groupBy("finding").agg((F.count(F.lit(1)) / F.max("size")).alias("covered"))
    )
    return plain.join(likely, "finding", "left").join(covered, "finding", "left").fillna({"pair_likelihood": UNSEEN, "covered": 0.0})


def score(rows: DataFrame, labelled: DataFrame, folder: str) -> DataFrame:
    """Add ``score`` (chance of a secret) to featured findings, by a forest trained on featured, labelled ones."""
    names = list(FEATURES)
    parts = [
        labelled.filter(F.col("label") == k).select("label", *names).orderBy(F.xxhash64(*names), *names).limit(LABELLED) for k in (0, 1)
    ]
    lessons = stored(parts[0].union(parts[1]), folder, "lessons")
    seen = [r.label for r in lessons.select("label").distinct().collect()]
    if len(seen) < 2:
        return rows.withColumn("score", F.lit(float(seen[0]) if seen else 0.0))
    vectors = VectorAssembler(inputCols=names, outputCol="_features")
    # At most 2 x LABELLED rows, in one sorted part, so that a run can be repeated.
    ready = vectors.transform(lessons.coalesce(1).sortWithinPartitions("label", *names)).withColumn("label", F.col("label").cast("double"))
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", probabilityCol="_chance", predictionCol="_guess", rawPredictionCol="_votes",
        numTrees=TREES, maxDepth=DEPTH, seed=17,
    ).fit(ready)
    out = forest.transform(vectors.transform(rows)).withColumn("score", vector_to_array("_chance")[1])
    return out.drop("_features", "_chance", "_guess", "_votes")


def scan(docs: DataFrame, labelled: DataFrame | None = None, folder: str | None = None, path: str = "source") -> DataFrame:
    """All findings with score and is_secret. Without labelled findings, those of known shape are the lessons."""
    folder = folder or shared_folder(docs.sparkSession)
    found = findings(docs, folder, path)
    pairs, common = ordinary_words(docs, folder)
    rows = stored(featured(known_shapes(found), pairs, common), folder, "featured")
    lessons = rows if labelled is None else featured(labelled, pairs, common)
    return score(rows, lessons, folder).withColumn("is_secret", F.col("score") >= 0.5)


def masked(value: Column) -> Column:
    """The first characters, four and a quarter at most, and the length."""
    return F.concat(F.left(value, F.least(F.lit(4), F.floor(F.length(value) / 4).cast("int"))), F.lit("...("), F.length(value).cast("string"), F.lit(")"))


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its verdict. Values are masked and named by their hash."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "number", "start", F.length("value").cast("long").alias("n_chars"), masked(F.col("value")).alias("masked"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret",
    )
