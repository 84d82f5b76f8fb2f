"""Secret scanning with a random forest against false positives (built-in functions only).

1. Candidates: runs of 12 and more token characters with a digit or in mixed case, or of 16 and more
   capitals or 24 and more letters; whole values of six and more characters that are assigned to
   a secret's name (by = or :); passwords of four and more in user:password@host addresses. A cheap
   pattern passes over the whole texts; only documents that hold a candidate are cut into words.
2. Features of a candidate: its length, its characters' classes and the transitions between
   them, how much of its letters the corpus's own dictionary covers (words outside candidates,
   counted by distinct texts, joined by word), the document's path or source, and the words around it.
3. Labelled findings train ``RandomForestClassifier``; its probability decides, so candidates
   that no rule knows are judged, too. Without findings of a person's, ``rule_labels`` labels
   the clear cases.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import name, stage_table, unused

TOKEN = r"[A-Za-z0-9+/_\-]{12,}"
WORTH = r"[0-9]|[a-z][A-Z]|^[A-Z]{16,}$|^[A-Za-z]{24,}$"
END = r"(?![A-Za-z0-9+/_\-])"
RUN = (r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*(?:[0-9]|[a-z][A-Z])|[A-Z]{16,}" + END + "|[A-Za-z]{24,}" + END + ")" + TOKEN)  # a whole candidate
SHARE = 1e-4  # of the distinct texts hold a dictionary word
TRAIN_FINDINGS = 20_000  # bound of the labelled findings that fit the forest
MASK = "<SECRET>"

# Formats of keys that providers publish, and names that stand before a value.
FORMATS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9\-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35})$"
SECRET_NAMES = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api_?key|access_?key|credential|bearer|private_?key)"
# From the run's start to the first name in it and on to its end, each character once: long runs stay
# linear. Group 1: what stands before the name; group 4: the value.
ASSIGNED = (r"(?<![A-Za-z0-9_\-])(?>([A-Za-z0-9_\-]*?)(?i:" + SECRET_NAMES.removeprefix("(?i)")
            + r"""))[A-Za-z0-9_\-]*+["'\])]{0,2}\s*+[=:]+\s*+(\S{6,})""")
ADDRESS = r"://[^\s/:@]*:([^\s/]{4,})@"
ANY = f"{RUN}|{ASSIGNED}|{ADDRESS}"
HARMLESS_NAMES = r"(?i)(commit|sha[0-9]*|md5|checksum|digest|etag|uuid|guid|order|invoice|phone|card|isbn|build|version)"
EXAMPLE_PATHS = r"(?i)(test|example|sample|fixture|mock|docs?/)"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, path, text_hash, word_index (words end at one white-space
    character), candidate, word, two words before it and one behind."""
    path = F.coalesce(name(path_col), F.lit("")) if path_col else F.lit("")
    d = docs.filter(name(text_col).rlike(ANY)).select(
        name(id_col).cast("long").alias("doc_id"), path.alias("path"), F.md5(name(text_col)).alias("text_hash"), name(text_col).rlike(ASSIGNED).alias("assigns"),
        F.split(F.translate(name(text_col), "\t\n\x0b\x0c\r", "     "), " ").alias("words"))

    def at(i: Column) -> Column:
        return F.coalesce(F.get("words", i), F.lit(""))

    def holds(i: Column) -> Column:
        return (at(i).rlike(f"{RUN}|{ADDRESS}")
                | (F.col("assigns") & F.concat_ws(" ", at(i - 2), at(i - 1), at(i)).rlike(ASSIGNED + "$")))

    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), holds)
    seen = F.transform(places, lambda i: F.struct(i.alias("word_index"), at(i).alias("word"), at(i - 1).alias("before"),
                                                  at(i - 2).alias("second_before"), at(i + 1).alias("behind")))
    rows = d.select("doc_id", "path", "text_hash", F.explode(seen).alias("s")).select("doc_id", "path", "text_hash", "s.*")
    tokens = F.filter(F.regexp_extract_all("word", F.lit(TOKEN), F.lit(0)), lambda c: c.rlike(WORTH))
    value = F.regexp_extract(F.concat_ws(" ", "second_before", "before", "word"), ASSIGNED + "$", 4)
    # Between its quotes, or without the punctuation that ends a sentence or a bracket.
    quoted = F.regexp_extract(value, r"""^(["'`])(.+?)\1""", 2)
    value = F.when(quoted != "", quoted).otherwise(F.regexp_replace(F.regexp_replace(value, r"""(?<!["'`,;.)\]}>])["'`,;.)\]}>]++$""", ""), r"""^["'`]+""", ""))
    values = F.filter(F.array(value), lambda c: F.length(c) >= 6)
    passwords = F.filter(F.array(F.regexp_extract("word", ADDRESS, 1)), lambda c: c != "")
    return rows.withColumn("candidate", F.explode(F.array_distinct(F.concat(tokens, values, passwords))))


def dictionary(docs: DataFrame, text_col: str = "text", least: int = 5, share: float = SHARE) -> DataFrame:
    """(part): lower-case words of four and more ASCII letters outside candidates that at least
    ``least`` texts, and ``share`` of the distinct texts more than that, hold. Copies of a text count once, and a
    secret's own letters never, however often it stands anywhere."""
    text = F.coalesce(name(text_col), F.lit(""))
    without = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ADDRESS, " "), ASSIGNED, "$1 "), RUN, " ")
    outside = F.when(text.rlike(ANY), without).otherwise(text)
    words = F.filter(F.array_distinct(F.split(F.lower(outside), "[^a-z]+")), lambda w: F.length(w) >= 4)
    texts = docs.select(F.md5(text).alias("h"), F.array_join(words, " ").alias("words")).groupBy("h", "words").agg(F.lit(1))
    # The empty word stands in every text and counts them.
    counts = stage_table(texts.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split("words", " ")))).alias("part"))
                         .groupBy("part").agg(F.count(F.lit(1)).alias("n")), "words")
    return counts.filter((F.col("part") != "") & (F.col("n") >= least + share * _texts(counts))).select("part")


def _texts(counts: DataFrame) -> int:
    return counts.filter("part = ''").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def coverage(found: DataFrame, known: DataFrame) -> DataFrame:
    """(candidate, covered): share of a candidate's characters that lie in dictionary words."""
    distinct = found.select("candidate").distinct()
    parts = distinct.select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{4,}"), F.lit(0))).alias("part"))
    return (parts.join(known, "part").groupBy("candidate").agg(F.sum(F.length("part")).alias("n"))
            .select("candidate", (F.col("n") / F.length("candidate")).alias("covered")))


def _share(candidate: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(candidate, pattern, "")) / F.length(candidate)


def _moves(classes: Column, a: str, b: str) -> Column:
    """How often class a is followed by class b, by character."""
    return (F.length(classes) - F.length(F.replace(classes, F.lit(a + b), F.lit(a)))) / F.length(classes)


def _own(candidate: Column) -> Column:
    """What stands before the candidate in its word."""
    return F.call_function("substring_index", F.col("word"), candidate, F.lit(1))


def _is_password(candidate: Column) -> Column:
    return F.regexp_extract("word", ADDRESS, 1) == candidate


def features(found: DataFrame, covered: DataFrame) -> tuple[DataFrame, list[str]]:
    """``found`` with numeric feature columns, and their names."""
    c = F.col("candidate")
    # One letter per class: a lower, A upper, 0 digit, - sign.
    classes = F.translate(F.translate(F.translate(F.translate(c, "bcdefghijklmnopqrstuvwxyz", "a" * 25), "BCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 25),
                                      "123456789", "0" * 9), "+/_", "---")
    own = _own(c)
    columns = {
        "f_length": F.length(c), "f_digits": _share(c, "[^0-9]"), "f_upper": _share(c, "[^A-Z]"), "f_lower": _share(c, "[^a-z]"),
        "f_signs": _share(c, "[A-Za-z0-9]"), "f_hex": _share(c, "[^0-9a-f]"), "f_vowels": _share(c, "[^aeiouAEIOU]"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "f_runs": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / F.length(c),
        **{f"f_{n}": _moves(classes, x, y) for n, x, y in (("lower_digit", "a", "0"), ("digit_lower", "0", "a"), ("upper_digit", "A", "0"),
                                                           ("digit_upper", "0", "A"), ("lower_upper", "a", "A"), ("any_sign", "a", "-"))},
        "f_covered": F.coalesce("covered", F.lit(0.0)),
        "f_example_path": F.col("path").rlike(EXAMPLE_PATHS), "f_path": F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(16)),
        "f_secret_name": F.concat_ws(" ", "second_before", "before", own).rlike(SECRET_NAMES),
        "f_harmless_name": F.concat_ws(" ", "second_before", "before", own).rlike(HARMLESS_NAMES),
        "f_assigned": own.rlike("[=:][\"']?$") | F.col("before").rlike("[=:]$"), "f_quoted": F.col("word").rlike("^[\"'].*[\"'][.,;]?$"),
        "f_address": F.col("word").rlike("@|://|\\.(com|org|net)") & ~_is_password(c), "f_behind": F.col("behind").rlike("^[a-z]+[.,]?$"),
        "f_alone": c == F.col("word"),
    }
    rows = found.join(covered, "candidate", "left")
    return rows.select(*[F.col(x) for x in found.columns], *[v.cast("double").alias(k) for k, v in columns.items()]), list(columns)


def rule_labels(rows: DataFrame) -> DataFrame:
    """``rows`` of ``features`` with label 1.0 (a provider's format, or a mixed value assigned to
    a secret's name or in the password's place of an address), 0.0 (digits only, an address, a harmless name, dictionary words) or null."""
    mixed = F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    named = ((F.col("f_secret_name") == 1) & (F.col("f_assigned") == 1)) | _is_password(F.col("candidate"))
    secret = F.col("candidate").rlike(FORMATS) | (named & mixed)
    harmless = ((F.col("f_digits") == 1) | (F.col("f_address") == 1) | (F.col("f_covered") > 0.6)
                | ((F.col("f_harmless_name") == 1) & (F.col("f_secret_name") == 0)))
    return rows.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0))


def train(labelled: DataFrame, names: list[str], most: int = TRAIN_FINDINGS, seed: int = 7):
    """A forest from labelled findings (label 0.0 / 1.0; null is left out), at most ``most`` of
    them by hash. None if a class is missing: there is nothing to tell apart."""
    known = labelled.filter("label is not null")
    if known.select("label").distinct().count() < 2:
        return None
    order = F.xxhash64("doc_id", "word_index", "candidate")
    sample = known.select("label", order.alias("h"), *names).orderBy("h").limit(most)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(sample).select("label", "features", "h")
    forest = RandomForestClassifier(numTrees=32, maxDepth=8, seed=seed, featureSubsetStrategy="sqrt")
    return forest.fit(vectors.repartition(1).sortWithinPartitions("h", "label").drop("h"))  # bounded: ``most`` rows


def _judged(docs: DataFrame, id_col: str, text_col: str, path_col: str | None, findings: DataFrame | None, threshold: float) -> DataFrame:
    found = stage_table(candidates(docs, id_col, text_col, path_col), "candidates")
    covered = stage_table(coverage(found, dictionary(docs, text_col)), "coverage")
    rows, names = features(found, covered)
    if findings is None:
        rows = rule_labels(rows)
    else:
        given = findings.select("doc_id", "word_index", "candidate", F.col("label").cast("double").alias("label")).dropDuplicates(
            ["doc_id", "word_index", "candidate"])
        rows = rows.join(given, ["doc_id", "word_index", "candidate"], "left")
    rows = stage_table(rows, "features")
    forest = train(rows, names)
    if forest is None:
        judged = rows.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
        judged = forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return judged.select("doc_id", "text_hash", "word_index", "candidate", "before", "behind", F.length("candidate").alias("length"),
                         F.col("f_covered").alias("covered"), "label", "score", (F.col("score") >= threshold).alias("is_secret"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Candidates with the forest's judgement: doc_id, word_index, candidate, before, behind,
    length, covered, label (null: no rule knew it), score, is_secret (score >= threshold).

    ``findings`` (doc_id, word_index, candidate, label) are a person's labels; without them
    ``rule_labels`` are used. If only one class is labelled, its label (else 0) is the score.
    Null text and texts without candidates give no rows; null paths are the empty path;
    candidates of null ids are reported under the null id; repeated rows repeat their
    candidates. An empty table gives no rows. Other input columns are ignored.
    """
    return _judged(docs, id_col, text_col, path_col, findings, threshold).drop("text_hash")


def _whole(value: Column) -> Column:
    """A pattern of the literal value that letters and digits do not go on around."""
    literal = F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), literal, F.lit("\\E(?![A-Za-z0-9])"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
           findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret that ``scan`` found in a document's text replaced by ``MASK`` there,
    values that are no token only where they are no part of a longer word. All rows and columns
    stay, null texts and ids as they are and columns of any name; texts without candidates are not
    moved. Secrets are kept by id and text, so rows without an id do not share theirs."""
    key, held = unused(docs, "secret_key"), unused(docs, "secrets")

    def key_of(doc_id: Column, text_hash: Column) -> Column:
        return F.concat_ws(":", text_hash, doc_id.cast("string"))

    secrets = (_judged(docs, id_col, text_col, path_col, findings, threshold).filter("is_secret")
               .groupBy(key_of(F.col("doc_id"), F.col("text_hash")).alias(key)).agg(F.collect_set("candidate").alias(held)))
    gate = F.coalesce(name(text_col).rlike(ANY), F.lit(False))
    # Longest first: a secret may be part of another.
    ordered = F.array_sort(name(held), lambda a, b: F.length(b) - F.length(a))
    masked = F.aggregate(F.coalesce(ordered, F.array().cast("array<string>")), name(text_col),
                         lambda t, s: F.when(s.rlike(f"^{TOKEN}$"), F.replace(t, s, F.lit(MASK)))
                         .otherwise(F.regexp_replace(t, _whole(s), F.lit(MASK))))
    hit = docs.filter(gate).withColumn(key, key_of(name(id_col).cast("long"), F.md5(name(text_col)))).join(secrets, key, "left")
    return docs.filter(~gate).unionByName(hit.withColumn(text_col, masked).select(*[name(c) for c in docs.columns]))
