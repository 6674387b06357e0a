"""Secret scan: a wide net for candidates, then a random forest that throws out
the false ones.

A candidate is a run of twelve or more token characters with a digit in it, or
whatever is assigned to a name, of any length from four and any make-up.
The forest sees its length and make-up, how likely its character transitions
are in ordinary words, how much of it dictionary words cover, its path, and the
words around it; it is trained from labelled findings.  Dictionary and
transitions are counted over all texts.  Built-in expressions and the
DataFrame-based forest only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import text_or_empty, words
from lexmill.session import materialize

TRAIN_FINDINGS = 20_000  # labelled findings used, by the smallest hash
TREES, DEPTH, SEED = 40, 8, 42
DICTIONARY_SOURCES = 3  # a dictionary word occurs in at least so many sources
DICTIONARY_WORD = 4  # letters at least
_TOKEN = "[A-Za-z0-9+/_\\-]{12,}={0,2}"
# A name, then = or : and perhaps a quote: in one word with the value, or before it.
_INSIDE = "[A-Za-z_][A-Za-z0-9_.\\-]*[\"'`\\])]*(?:[=:]+>?)[\"'`(]*([^\"'`\\s]{4,})"
_NAME_BEFORE = "[A-Za-z][\"'`\\])]*[=:]+>?[\"'`(]*$"
_SIGN = "^[=:]+>?$"
_OUTSIDE = "^[\"'`(\\[{<]+|[\"'`)\\]}>;,]+$"
_RARE = -7.0  # log probability of a transition that no word has

FEATURES = [
    "length", "digits", "uppers", "lowers", "symbols", "switches", "transitions", "coverage",
    "before_odds", "after_odds", "assigned", "quoted", "depth", "test_path", "code_path",
]


def candidates(docs: DataFrame, *, id_col: str, text: str | Column, path: str | Column) -> DataFrame:
    """``id``, ``path``, ``word_no``, ``value`` and the words around each candidate.

    ``before`` is the nearest text with a letter out of what stands before the
    value in its own word and the two words before it.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit("")).alias("path"),
        words(text_or_empty(text)).alias("w"),
    ).filter("size(w) > 0")
    zipped = F.arrays_zip(
        F.col("w").alias("word"), F.concat(F.array(F.lit("")), "w").alias("prev"),
        F.concat(F.array(F.lit(""), F.lit("")), "w").alias("prev2"),
        F.slice("w", 2, F.size("w")).alias("after"), F.sequence(F.lit(0), F.size("w") - 1).alias("word_no"),
    )
    word, prev = F.col("word"), F.col("prev")
    token = (F.length(word) >= 12) & word.rlike(_TOKEN) & word.rlike("[0-9]")
    named = prev.rlike(_NAME_BEFORE) | (prev.rlike(_SIGN) & F.col("prev2").rlike("[A-Za-z]"))
    inner = F.contains(word, F.lit("=")) | F.contains(word, F.lit(":"))
    near = rows.select("id", "path", F.inline(zipped)).filter(token | named | inner)
    tokens = F.when(token, F.filter(F.regexp_extract_all(word, F.lit(f"({_TOKEN})"), F.lit(1)), lambda v: v.rlike("[0-9]")))
    inside = F.when(inner, F.regexp_replace(F.regexp_extract(word, _INSIDE, 1), _OUTSIDE, ""))
    behind = F.when(named, F.regexp_replace(word, _OUTSIDE, ""))
    none = F.array().cast("array<string>")
    # a value is not the sign itself, an address, or what a token already is
    assigned = F.filter(
        F.array(inside, behind),
        lambda v: v.isNotNull() & (F.length(v) >= 4) & ~F.startswith(v, F.lit("//")) & v.rlike("[A-Za-z0-9]"),
    )
    values = F.array_union(F.coalesce(tokens, none), assigned)
    found = near.withColumn("value", F.explode(values))
    key = F.expr("substring_index(word, value, 1)")
    lead = F.when(key.rlike("[A-Za-z]"), key).when(F.col("prev").rlike("[A-Za-z]"), F.col("prev")).otherwise(F.col("prev2"))
    joint = F.concat_ws(" ", F.when(key.rlike("[A-Za-z]"), F.lit("")).otherwise(F.col("prev")), key)
    return found.select(
        "id", "path", "word_no", "value", _plain(lead).alias("before"), _plain(F.coalesce("after", F.lit(""))).alias("after"),
        joint.rlike("[=:]").cast("double").alias("assigned"), key.rlike("[\"'`]").cast("double").alias("quoted"),
    )


def _plain(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z]+", "")


def dictionary(docs: DataFrame, *, text: str, source: str) -> DataFrame:
    """``word`` and ``n``: lower-case letter runs that several sources use."""
    runs = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(f"[a-z]{{{DICTIONARY_WORD},}}"), F.lit(0))
    return (
        docs.select(F.col(source).alias("source"), F.explode(runs).alias("word"))
        .groupBy("word", "source").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"))
        .filter(F.col("sources") >= DICTIONARY_SOURCES)
        .select("word", "n")
    )


def transitions(known: DataFrame) -> DataFrame:
    """``pair`` and the log probability of its second letter; at most 26 * 26 rows."""
    pairs = (
        known.select("n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"), "word")
        .select("n", F.substr("word", F.col("i"), F.lit(2)).alias("pair"))
        .groupBy("pair").agg(F.sum("n").alias("n"))
    )
    firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("total"))
    return pairs.join(firsts, F.substring("pair", 1, 1) == F.col("first")).select(
        "pair", F.log(F.col("n") / F.col("total")).alias("logp")
    )


def value_features(values: DataFrame, known: DataFrame) -> DataFrame:
    """Features of distinct ``value`` rows that do not depend on where they stand."""
    n = F.length("value")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / n
    shape = values.select(
        "value", n.cast("double").alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"),
        share("[a-z]").alias("lowers"), share("[^A-Za-z0-9]").alias("symbols"),
        share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]").alias("switches"),
    )
    pairs = values.select("value", F.explode(F.sequence(F.lit(1), n - 1)).alias("i")).select(
        "value", F.lower(F.substr("value", F.col("i"), F.lit(2))).alias("pair")
    )
    moves = (
        pairs.join(F.broadcast(transitions(known)), "pair", "left")  # at most 26 * 26 rows
        .groupBy("value").agg(F.avg(F.coalesce("logp", F.lit(_RARE))).alias("transitions"))
    )
    runs = values.select(
        "value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(f"[a-z]{{{DICTIONARY_WORD},}}"), F.lit(0))).alias("word")
    )
    covered = runs.join(known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    return (
        shape.join(moves, "value").join(covered, "value", "left")
        .withColumn("coverage", F.coalesce("covered", F.lit(0)) / F.col("length")).drop("covered")
    )


def _odds(labelled: DataFrame, column: str) -> DataFrame:
    """Smoothed log odds of label 1 by neighbouring word, from the bounded training rows."""
    positive = F.sum("label")
    return labelled.groupBy(column).agg(
        F.log((positive + 1) / (F.count(F.lit(1)) - positive + 1)).alias(f"{column}_odds")
    )


def _described(found: DataFrame, values: DataFrame, training: DataFrame) -> DataFrame:
    out = found.join(values, "value")
    for column in ("before", "after"):
        # at most TRAIN_FINDINGS rows
        out = out.join(F.broadcast(_odds(training, column)), column, "left").withColumn(
            f"{column}_odds", F.coalesce(f"{column}_odds", F.lit(0.0))
        )
    path = F.lower("path")
    return out.withColumns({
        "depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "test_path": path.rlike("test|example|sample|fixture|mock|docs?/").cast("double"),
        "code_path": path.rlike("[.](py|js|ts|go|java|rb|sh|env|ya?ml|json|toml|ini|cfg|conf|tf)$").cast("double"),
    })


def scan(
    docs: DataFrame,
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    path: str = "source",
    source: str = "source",
) -> DataFrame:
    """Columns id, ``word_no`` (place in the text's words), ``value``, ``score`` and
    ``is_secret``, for every candidate of every text.

    ``labelled`` has the columns of :func:`candidates` and ``label`` (1: secret).
    Of its rows at most ``TRAIN_FINDINGS`` are used.  If their labels are all
    alike, every candidate scores that label, and 0.5 without labels.  Null and
    empty texts have no candidates, null paths count as empty; repeated rows
    are scanned each; an empty table gives an empty result.
    """
    known = materialize(dictionary(docs, text=text, source=source), "dictionary")
    training = materialize(
        labelled.filter("label in (0, 1)").orderBy(F.xxhash64("value", "before", "after", "path"), "value", "word_no")
        .limit(TRAIN_FINDINGS),
        "labelled",
    )
    found = materialize(candidates(docs, id_col=id_col, text=text, path=path), "secret-candidates")
    classes = training.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).first()
    if classes["n"] == 0 or classes["a"] == classes["b"]:
        level = 0.5 if classes["n"] == 0 else float(classes["a"])
        scored = found.withColumn("score", F.lit(level))
    else:
        distinct = found.select("value").unionByName(training.select("value")).distinct()
        values = materialize(value_features(materialize(distinct, "values"), known), "value-features")
        pack = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(
            numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features"
        ).fit(pack.transform(_described(training.withColumn("label", F.col("label").cast("double")), values, training)))
        scored = forest.transform(pack.transform(_described(found, values, training))).withColumn(
            "score", F.get(vector_to_array("probability"), F.lit(1))
        )
    return scored.select(
        F.col("id").alias(id_col), F.col("word_no").cast("long").alias("word_no"), "value", "score",
        (F.col("score") >= 0.5).alias("is_secret"),
    )


def audited(found: DataFrame) -> DataFrame:
    """Labels by rules that an audit of findings would settle at sight: a key of a
    fixed provider format, or a value that a secret's name is assigned to."""
    fixed = F.col("value").rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") | F.col("value").rlike("^gh[pousr]_[A-Za-z0-9]{36}$")
    named = F.col("before").rlike("(password|passwd|secret|token|apikey|credential)$") & (F.col("assigned") == 1)
    return found.withColumn("label", (fixed | named).cast("int"))
