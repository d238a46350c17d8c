"""Operator 5: secret scans with a random forest that removes false findings. DataFrame functions and Spark ML only."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avsync.session import settle

#: words that name a credential, before or inside a finding
NAMES = r"(?i)(pass(wor[dt]|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)"
#: forms that are credentials whatever stands around them
FORMS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+|-*BEGIN( [A-Z0-9]+){0,3} PRIVATE KEY( BLOCK)?-*)$"
#: the header of a private key, over the words from its BEGIN on
HEADER = r"^\S*?(-*BEGIN(?: [A-Z0-9]+){0,3} PRIVATE KEY(?: BLOCK)?-*)"
#: a credential's name with its value somewhere in a word
INSIDE = NAMES + r"[A-Za-z0-9_.-]{0,40}[\"']?[=:]+[\"'(\[{<]*[^\s\"'&,;]+"
#: an address as a whole value
MAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"
#: a link that carries a password
USER = r"://[^/\s:@]*:([^/\s@]+)@"
#: words between a credential's name and its value
LINKS = ["=", ":", "=>", ":=", "->", "is", "was"]
#: words without a digit are findings beside a credential's name only, shorter ones too
LEAST_LENGTH = 8
FEATURES = ["length", "digits", "uppers", "lowers", "others", "changes", "case_changes", "different", "hex", "covered", "path", "mail", "number", "named", "assigned", "quoted", "key_before", "word_before"]


def findings(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates of whole texts: doc_id, word_no, word, name, value, before2, before, after, follows.

    Words stand between ASCII white space. A candidate is a word with a run of at least
    LEAST_LENGTH characters that has a digit; any value that is assigned to a credential's
    name, in the word's beginning or inside, or follows one (``follows``: directly, or after
    one of LINKS); a link with a password (USER); and the header of a private key, at its first word. ``value`` is the run
    without quotes, closing signs and the name it is assigned to; one word may give several.
    """
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    rows = df.select(F.col(doc_id).alias("doc_id"), words.alias("words"))
    digits = lambda w: (F.length(w) >= LEAST_LENGTH) & w.rlike("[0-9]")
    marked = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("word_no"), w.alias("word"))),
        lambda x: digits(x["word"]) | x["word"].rlike(NAMES) | x["word"].rlike("BEGIN$") | x["word"].rlike(USER),
    )
    rows = rows.select("doc_id", "words", marked.alias("marked"))
    beside = F.transform(F.filter("marked", lambda x: x["word"].rlike(NAMES)), lambda x: x["word_no"])
    rows = rows.select("doc_id", "words", F.transform("marked", lambda x: x["word_no"]).alias("marked"), beside.alias("beside"))
    places = F.array_distinct(F.concat("marked", F.transform("beside", lambda i: i + 1), F.transform("beside", lambda i: i + 2)))
    rows = rows.select("doc_id", "words", F.filter(places, lambda i: i < F.size("words")).alias("places"))
    at = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    header = lambda i: F.when(at(i).rlike("BEGIN$"), F.regexp_extract(F.array_join(F.slice("words", i + 1, 7), " "), HEADER, 1)).otherwise("")
    place = lambda i: F.struct(
        i.alias("word_no"), at(i).alias("word"), at(i - 2).alias("before2"), at(i - 1).alias("before"), at(i + 1).alias("after"), header(i).alias("header")
    )
    rows = rows.select("doc_id", F.explode(F.transform("places", place)).alias("c")).select("doc_id", "c.*")
    # a name that has its value in its own word gives none to the next
    bare_name = lambda c: F.col(c).rlike(NAMES) & ~F.col(c).rlike(r"[=:]+[\"'(\[{<]*[^\s=:\"'(\[{<>]")
    rows = rows.withColumn("follows", bare_name("before") | (F.col("before").isin(LINKS) & bare_name("before2")))
    opening, closing = r"^[\"'(\[{<]*([A-Za-z_][A-Za-z0-9_.-]*[\"']?[=:]+)?[\"'(\[{<]*", r"[\"')\]}>,;.!?#*$%&|]+$"
    name = F.regexp_extract("word", r"^[\"'(\[{<]*([A-Za-z_][A-Za-z0-9_.-]*)[\"']?[=:]", 1)
    bare = F.regexp_replace("word", opening + "|" + closing, "")
    signs = F.regexp_replace("word", opening + r"|[\"'),;]+$", "")  # a value of closing signs only
    rows = rows.withColumn("name", name).withColumn("value", F.when(F.col("header") != "", F.col("header")).when(bare != "", bare).otherwise(signs))
    named = F.col("name").rlike(NAMES)
    is_value = (
        (F.col("header") != "")
        | F.col("word").rlike(USER)
        | (digits(F.col("word")) & digits(F.col("value")))
        | ((named | F.col("follows")) & ~F.col("value").rlike("^[=:>-]*$") & ~F.col("value").isin(LINKS))
    )
    own = F.when(is_value, F.array(F.struct("name", "value"))).otherwise(F.array())
    inner = F.transform(
        F.regexp_extract_all("word", F.lit(INSIDE), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, "^[A-Za-z0-9_.-]+", 0).alias("name"), F.regexp_replace(m, r"^[A-Za-z0-9_.-]+[\"']?[=:]+[\"'(\[{<]*|" + closing, "").alias("value")),
    )
    values = F.concat(own, F.when(named | (F.col("header") != ""), F.array()).otherwise(F.filter(inner, lambda x: x["value"] != "")))
    rows = rows.withColumn("found", F.explode(F.array_distinct(values)))
    return rows.select("doc_id", "word_no", "word", "before2", "before", "after", "follows", "found.name", "found.value")


def dictionary(df: DataFrame, text: str = "text", least_documents: int = 3) -> DataFrame:
    """Words of three to twelve ASCII letters that stand in so many documents."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.array_distinct(F.filter(F.split(lower, r"[^a-z0-9]+"), lambda w: w.rlike("^[a-z]{3,12}$")))
    return df.select(F.explode(words).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).filter(F.col("n") >= least_documents).select("piece")


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", pattern, "")) / F.length("value")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Findings with the features of the forest."""
    found = found.withColumn("finding", F.xxhash64("value"))
    pieces = found.select("finding", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(r"([a-z]{3,12})"), 1))).alias("piece")).distinct()
    covered = pieces.join(words, "piece").groupBy("finding").agg(F.sum(F.length("piece")).alias("letters"))
    found = found.join(covered, "finding", "left")
    change = lambda of, to: F.regexp_count("value", F.lit(f"(?<={of})(?={to})"))
    letter, digit = "[A-Za-z]", "[0-9]"
    user = F.regexp_extract("word", USER, 1)  # a password between user and host counts as assigned to a name
    named = F.col("name").rlike(NAMES) | F.col("follows") | (user != "")
    assigned = (user != "") | (F.col("name") != "") | F.col("before").isin("=", ":", "=>") | (F.col("follows") & F.col("before").rlike("[=:]$"))
    number = lambda c: F.when(c, 1.0).otherwise(0.0)
    return found.select(
        "doc_id",
        "word_no",
        "value",
        "name",
        "before",
        user.alias("user"),
        F.length("value").cast("double").alias("length"),
        _share(r"[^0-9]").alias("digits"),
        _share(r"[^A-Z]").alias("uppers"),
        _share(r"[^a-z]").alias("lowers"),
        _share(r"[A-Za-z0-9]").alias("others"),
        ((change(letter, digit) + change(digit, letter)) / F.length("value")).alias("changes"),
        ((change("[a-z]", "[A-Z]") + change("[A-Z]", "[a-z]")) / F.length("value")).alias("case_changes"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.length("value")).alias("different"),
        _share(r"[^0-9a-f]").alias("hex"),
        F.least(F.lit(1.0), F.coalesce("letters", F.lit(0)) / F.length("value")).alias("covered"),
        number(F.col("value").rlike(r"[/\\]")).alias("path"),
        number(F.col("value").rlike(MAIL) & ~named).alias("mail"),
        number(F.col("value").rlike(r"^[0-9().+:,/\\-]+$")).alias("number"),
        number(named).alias("named"),
        number(assigned).alias("assigned"),
        number(F.col("word").rlike("[\"']")).alias("quoted"),
        number(F.col("before").rlike(NAMES) | F.col("before2").rlike(NAMES)).alias("key_before"),
        number(F.col("before").rlike(r"^[A-Za-z]+[.,]?$")).alias("word_before"),
    )


def sure_label() -> Column:
    """Of findings whose nature is beyond doubt: 1 a known form, or a random value given to a
    credential's name (letters only, if they change case as random ones do), or a password of
    letters and digits in a link; 0 an address or a number with signs only, neither beside a
    credential's name, a word in a sentence, beside a credential's name only one that
    other documents have too. Null where in doubt."""
    random = (F.col("length") >= 16) & (F.col("digits") > 0.1) & (F.col("digits") < 0.95) & (F.col("others") < 0.2) & (F.col("covered") < 0.5)
    letters = (F.col("length") >= 16) & (F.col("case_changes") > 0.4) & (F.col("others") < 0.2) & (F.col("covered") < 0.5)
    link = (F.length("user") >= LEAST_LENGTH) & F.col("user").rlike("[0-9]") & F.col("user").rlike("[A-Za-z]")
    yes = F.col("value").rlike(FORMS) | ((F.col("named") == 1) & (F.col("assigned") == 1) & (random | letters)) | link
    common = (F.col("assigned") == 0) & F.col("value").rlike("^[A-Z]?[a-z]*$") & ((F.col("covered") == 1) | (F.col("length") <= 2))
    no = (F.col("mail") == 1) | ((F.col("number") == 1) & (F.col("named") == 0)) | ((F.col("assigned") == 0) & (F.col("named") == 0) & ((F.col("covered") > 0.5) | (F.col("digits") < 0.1))) | common
    return F.when(yes, 1.0).when(no, 0.0)


def labelled(found: DataFrame) -> DataFrame:
    """Findings whose nature is beyond doubt, with ``sure_label`` as label."""
    return found.withColumn("label", sure_label()).filter("label is not null")


def train(examples: DataFrame, most_rows: int = 20_000, trees: int = 30, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel | None:
    """A forest on at most ``most_rows`` labelled findings of each class, those of lowest hash
    (equal values count once). With one class only there is nothing to tell apart: None."""
    distinct = examples.dropDuplicates(["value", "named", "assigned"]).withColumn("at", F.xxhash64("value", "named", "assigned"))
    parts = [distinct.filter(F.col("label") == k).orderBy("at").limit(most_rows) for k in (0.0, 1.0)]
    rows = settle(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(parts[0].unionByName(parts[1])).select("label", *FEATURES), "examples")
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)


def judged(found: DataFrame, model: RandomForestClassificationModel | PipelineModel | None, least: float = 0.5) -> DataFrame:
    """Findings with their probability and whether they count as secrets; without a model
    those do that ``sure_label`` gives 1, with probability 1, and no others.
    Known forms and key headers are secrets whatever the model says."""
    if model is None:
        sure = F.coalesce(sure_label(), F.lit(0.0))
        return found.withColumn("probability", sure).withColumn("secret", sure == 1)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    return model.transform(vectors).withColumn("probability", F.when(F.col("value").rlike(FORMS), 1.0).otherwise(vector_to_array("probability")[1])).withColumn("secret", F.col("probability") >= least)


def scan_secrets(df: DataFrame, examples: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """All findings of all documents: doc_id, word_no (position among the words; a word may have several values), value_sha256, length, probability, secret.

    ``examples`` are labelled findings (as of ``described``, with a label); without any, the
    findings whose nature is beyond doubt are used. A null or empty text has no findings; a
    null doc_id is kept; equal rows are findings of their own. No text: no rows. The value
    itself is not returned, its hash is. Other columns are not read.
    """
    found = settle(described(settle(findings(df, doc_id, text), "findings"), dictionary(df, text)), "described")
    model = train(labelled(found) if examples is None else examples)
    return judged(found, model, least).select(
        F.col("doc_id").alias(doc_id), F.col("word_no").cast("long").alias("word_no"), F.sha2("value", 256).alias("value_sha256"), F.col("length").cast("long").alias("length"), "probability", "secret"
    )
