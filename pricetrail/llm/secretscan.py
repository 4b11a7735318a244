"""Secret scan with a random forest that removes false positives.

Candidates are all long tokens, in every part of a word, that hold a digit or
stand after a name that announces a secret, dotted web tokens whole, and
passwords inside addresses. The forest sees a candidate's length, its character
transitions, how much of it dictionary words cover, whether it is part of a
path or address, and its neighbouring words. It learns from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import write_out

LEAST_LENGTH = 12
#: Words that announce a secret, words that announce none, and filler inside placeholders.
ANNOUNCING = "password|passwd|pwd|secret|token|apikey|api_key|api-key|access|auth|credential|private"
HARMLESS = "example|sample|dummy|test|commit|sha1|sha256|md5|checksum|digest|uuid|isbn|card|phone|call|order|invoice"
FILLER = "example|sample|placeholder|changeme|change|dummy|test|your|here|insert|secret|password|token|apikey|key|none|null|todo|value|abc|xxx|123"
#: Token shapes that providers give out, and that are therefore labelled true without a forest.
ISSUED = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^xox[abprs]-[0-9A-Za-z-]{10,}$|^sk_(live|test)_[0-9A-Za-z]{16,}$|^AIza[0-9A-Za-z_-]{35}$"
FEATURES = [
    "length", "transitions", "letter_changes", "distinct", "digits", "uppers", "vowels", "covered", "path", "at_sign",
    "announced_inside", "announced_near", "harmless_near", "quoted", "issued",
]
#: Documented bound of the labelled sample: findings per label, chosen by hash.
PER_LABEL = 10_000
CUT = 0.5
#: Characters of context kept on each side of a value, and of each neighbouring word.
AROUND = 60
_TOKEN = rf"[A-Za-z0-9_+/\-]{{{LEAST_LENGTH},}}={{0,2}}"
_DOTTED = r"eyJ[A-Za-z0-9_\-]{8,}(?:\.{1,2}[A-Za-z0-9_\-]+){1,4}"
_QUOTES = r"[\"'`\\\]\[(){}<$]*"
#: Groups: what lies between the values, name, separator, user part of an address, value; what follows is looked at only.
#: A match starts where the last one ends, so that what follows the last value is read once.
FINDING = (
    rf"(?s)\G(.*?)(?:([A-Za-z_][A-Za-z0-9_.\-]{{0,{AROUND}}})({_QUOTES}(?:[=:]{{1,3}}>?|>){_QUOTES})|(://[^\s/:@]{{0,{AROUND}}}:)(?=[^\s/:@]{{{LEAST_LENGTH},}}@))?"
    rf"({_DOTTED}|{_TOKEN})(?=(.{{0,{AROUND}}}))"
)
#: What ends the piece of a word that a value belongs to.
_EDGE = r"=?&\"'`<>;,(){}\[\]|"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, place, word, value, inside, near): each candidate with its word's place and surroundings.

    A null or empty text has none. Words are cut at white space, so a text of any
    length is one pass over its words; only long ones that may hold a candidate
    go on, and each gives all its values. `word` is the piece around the value up
    to the next separators, `inside` the name before it in its word. Every
    neighbouring word is cut on its own, at the end that faces the value.
    """
    words = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    rows = docs.select("doc_id", words.alias("w"))
    names = rf"(?i)({ANNOUNCING})"
    closing = F.lit(rf"{names}[A-Za-z0-9_.\-]*{_QUOTES}[=:]{{1,3}}>?{_QUOTES}$")
    before = lambda i, k: F.when(i >= k, F.get("w", i - k))

    def led(i: Column) -> Column:
        """Whether the words before announce a value: `name:`, or `name =`."""
        apart = before(i, 1).rlike(r"^(:|=|:=|=>|==)$") & F.rlike(F.substring(before(i, 2), -AROUND, AROUND), F.lit(rf"{names}[A-Za-z0-9_.\-]*{_QUOTES}$"))
        # Either way the word before holds one of the two signs, which is cheaper to look for.
        told = before(i, 1).contains("=") | before(i, 1).contains(":")
        return F.coalesce(told & (F.rlike(F.substring(before(i, 1), -AROUND, AROUND), closing) | apart), F.lit(False))

    def long_word(x: Column, i: Column) -> Column:
        shaped = (F.length(x) >= LEAST_LENGTH) & x.rlike(rf"[A-Za-z0-9_+/\-]{{{LEAST_LENGTH},}}|://")
        named = x.rlike("[=:>]") & x.rlike(rf"{names}[A-Za-z0-9_.\-]{{0,{AROUND}}}{_QUOTES}[=:>]")
        return shaped & (x.rlike(r"[0-9]|://") | named | led(i))

    rows = rows.select("doc_id", "w", F.filter(F.transform("w", lambda x, i: F.when(long_word(x, i), i)), lambda i: i.isNotNull()).alias("at"))
    # Of a plain explode Spark infers a filter on the list's size, for which it would make the list, and the words, twice.
    rows = rows.select("doc_id", "w", F.explode_outer("at").alias("place")).where("place IS NOT NULL")
    place = F.col("place")
    ends = [F.substring(before(place, k), -100, 100) for k in (3, 2, 1)] + [F.substring(F.get("w", place + 1), 1, 100)]
    near = F.lower(F.array_join(F.filter(F.array(*ends), lambda x: x.isNotNull()), " "))
    rows = rows.select("doc_id", "place", F.get("w", place).alias("w"), near.alias("near"), led(place).alias("led"))
    # The groups of a match stand at one index of six lists.
    groups = [F.regexp_extract_all("w", F.lit(FINDING), F.lit(k)) for k in range(1, 7)]
    rows = rows.select("doc_id", "place", "near", "led", F.posexplode_outer(F.arrays_zip(*[g.alias(f"g{k}") for k, g in enumerate(groups, 1)])).alias("nth", "g")).where("nth IS NOT NULL")
    g = {k: F.col(f"g.g{k}") for k in range(1, 7)}
    address = g[4] != ""
    head = F.concat(F.substring(g[1], -AROUND, AROUND), g[2], g[3])
    piece = F.concat(F.regexp_extract(head, rf"([^{_EDGE}]*)$", 1), g[5], F.regexp_extract(g[6], rf"^([^{_EDGE}]*)", 1))
    quote = F.concat(F.substring(F.concat(g[1], g[3]), -1, 1), F.substring(g[6], 1, 1)).rlike("[\"'`]")
    rows = rows.select(
        "doc_id", "place", F.when(address, g[5]).otherwise(piece).alias("word"), g[5].alias("value"),
        F.when(address, F.lit("password")).otherwise(F.lower(g[2])).alias("inside"), "near", quote.alias("quote"), ((F.col("nth") == 0) & F.col("led")).alias("led"),
    )
    return rows.where(F.col("value").rlike("[0-9]") | F.col("inside").rlike(ANNOUNCING) | F.col("led")).drop("led")


def with_features(found: DataFrame) -> DataFrame:
    v, n = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    return found.withColumns({
        "length": n.cast("double"),
        "transitions": share(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        "letter_changes": share(r"(?i)(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "vowels": share("(?i)[aeiou]"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(v), FILLER, "")) / n,
        "path": flag(F.col("word").rlike(r"://|^\.{0,2}/|/.*/|\.(com|org|net|html?|json|py|md|txt)\b")),
        "at_sign": flag(F.col("word").contains("@")),
        "announced_inside": flag(F.col("inside").rlike(ANNOUNCING)),
        "announced_near": flag(F.col("near").rlike(ANNOUNCING)),
        "harmless_near": flag(F.col("near").rlike(HARMLESS) | F.col("inside").rlike(HARMLESS)),
        "quoted": flag(F.col("quote")),
        "issued": flag(v.rlike(ISSUED)),
    })


def seed_label() -> Column:
    """Label of findings that need no judgement, null for the rest: issued shapes and announced
    random tokens are secrets; bare numbers, placeholders, addresses and readable words are not."""
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    announced = (F.col("announced_inside") == 1) | (F.col("announced_near") == 1)
    return (
        F.when((F.col("covered") >= 0.4) | F.col("value").rlike(r"^[0-9_+/\-]*$") | (F.col("at_sign") == 1) | F.col("value").rlike(r"^(.)\1+$"), 0.0)
        .when(F.col("issued") == 1, 1.0)
        .when(announced & mixed & (F.col("length") >= 16) & (F.col("path") == 0) & (F.col("distinct") >= 0.2), 1.0)
        .when(~announced & (F.col("digits") < 0.15) & (F.col("letter_changes") > 0.5), 0.0)
    )


def fit(findings: DataFrame, label: str = "label", seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from rows of features with a 0/1 label (null: unlabelled); None without both labels.

    At most PER_LABEL findings of each label are used, by the hash of their value.
    """
    sides = [findings.where(F.col(label) == x).orderBy(F.xxhash64("value", "near"), "value").limit(PER_LABEL) for x in (0.0, 1.0)]
    sample = write_out(sides[0].unionByName(sides[1]).select(*FEATURES, F.col(label).alias("label")), "secrets-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=24, maxDepth=6, featureSubsetStrategy="sqrt", subsamplingRate=0.7, seed=seed).fit(rows)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, place, value, kind, score, is_secret): every candidate of every whole text.

    score is the forest's probability. Without findings of both labels there is
    no forest, and the label itself, or 0, is the score. Rows with a null doc_id
    keep it; repeated rows repeat their findings.
    """
    found = write_out(with_features(candidates(docs)).withColumn("label", seed_label()), "secrets-found")
    model = fit(found)
    if model is None:
        scored = found.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    kind = F.when(F.col("issued") == 1, "issued").when((F.col("announced_inside") == 1) | (F.col("announced_near") == 1), "announced").otherwise("bare")
    return scored.select("doc_id", "place", "value", kind.alias("kind"), "score", (F.col("score") >= CUT).alias("is_secret"))


def redacted(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The documents with every found secret replaced by `mark`; no row goes, all columns stay.

    n_chars, where there is such a column, follows the text.
    """
    # Longer values first, so that one inside another leaves no rest.
    by_length = lambda x, y: F.length(y) - F.length(x)
    hits = scan(docs).where("is_secret").groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set("value"), by_length).alias("_found"))
    held = docs.join(write_out(hits, "secrets-hits"), docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    clean = F.aggregate("_found", F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark)))
    held = held.withColumn("text", F.when(F.col("_found").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        held = held.withColumn("n_chars", F.when(F.col("_found").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return held.select(*docs.columns)
