"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is each run of MIN_LENGTH or more of ``A-Z a-z 0-9 + / _ -`` in a blank-separated word of a text, and each value of any length and any
characters behind a keyword and = or : (in its word, or up to two words before), unless it is such a run itself. A quoted value ends at its quote or a blank, another also at
one of ``, ; & < > ( ) { } [ ]``; a value with blanks is taken up to the first. The context of a candidate begins at the run before it in its word, so a word with many
candidates costs no more than its length. The features are length, character transitions
(changes of class, and how usual its letter pairs are in the words of the corpus), dictionary coverage (letters in words that the corpus uses often), hints of
the path, and the neighbouring words. The dictionary and the letter pairs are counted over all documents. The forest is trained from labelled findings,
at most MAX_FINDINGS of each label, drawn by a hash; it then scores every candidate, and those below CUT are taken for false positives.

Edge cases: a null or empty text has no candidates; a null path is an empty one; repeated rows are documents of their own; a document without
an id takes part; extra columns are left out; findings with a null label are not used for training; without findings of both labels nothing is removed and the score
is 1; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm.flow import materialize, small

MIN_LENGTH = 16
# characters of a long run or word that are looked at beside a candidate
NEAR = 64
# words of the dictionary: at least this many letters and uses
MIN_LETTERS, MIN_USES = 3, 20
MAX_FINDINGS, TREES, DEPTH, SEED, CUT = 5000, 30, 7, 3, 0.5

# fixed values: words near a secret, near a made-up one, and in paths
KEYWORDS = "password|passwd|pwd|secret|token|apikey|api_key|api-key|access|auth|bearer|credential|private|key"
SAMPLE_WORDS = "example|sample|dummy|placeholder|changeme|redacted|your"
SAMPLE_PATHS = "test|spec|mock|example|sample|fixture|doc"
CONFIG_PATHS = r"\.env|config|settings|credential|secret|deploy|\.ya?ml|\.json|\.ini|\.properties|\.toml"
RUN = f"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
# a keyword with the rest of its name, what assigns, and a value: up to its quote, or up to what ends an unquoted one
NAME = f"(?:{KEYWORDS})[A-Za-z0-9_.-]{{0,{NEAR}}}[\\\\\"'`\\])]*"
ASSIGNS = "(?>:{1,2}=?|=>|={1,3})"
VALUE = "((?<=\")[^\"\\s]+|(?<=')[^'\\s]+|(?<=`)[^`\\s]+|(?<![\"'`])[^\\s\"'`,;&<>(){}\\[\\]]+)"
OPENS = "\\\\*[\"'`]?"
IN_WORD = f"(?i)({NAME}{ASSIGNS}{OPENS}){VALUE}"

FEATURES = ["length", "changes", "digits", "uppers", "symbols", "kinds", "usual_pairs", "coverage", "path_depth", "path_sample", "path_config", "assigned", "keyword", "sample_word", "quoted", "word_before", "word_after"]


def candidates(docs: DataFrame, path_col: str) -> DataFrame:
    """A row for each candidate: document, number of the word (from 0), number of the candidate in it (runs, then values), the candidate, what
    stands before it in its word, and the words around it."""
    d = docs.select("doc_id", F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("th"))
    behind = f"(?i){NAME}\\s*{ASSIGNS}"
    d = d.where(F.col("text").rlike(RUN) | F.col("text").rlike(behind)).select("doc_id", "th", "path", F.split("text", "[ \\t\\n\\r]+").alias("w"))
    word = lambda i: F.when(i >= 0, F.get("w", i)).otherwise("")
    near = lambda i: F.substring(word(i), -NEAR, NEAR)
    # the words before end in a keyword that assigns, or in a keyword and this word assigns
    given = lambda i: F.concat_ws(" ", near(i - 2), near(i - 1)).rlike(f"(?i){NAME} ?{ASSIGNS}$")
    named = lambda i, x: x.rlike(f"^{ASSIGNS}.") & near(i - 1).rlike(f"(?i){NAME}$")
    wanted = lambda s: s["word"].rlike(RUN) | s["word"].rlike(IN_WORD) | given(s["at"]) | named(s["at"], s["word"])
    # explode_outer: for the inner one Spark would infer a filter on the array and split each text twice
    d = d.select("*", F.explode_outer(F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("word"))), wanted)).alias("s")).where("s is not null")
    at, x = F.col("s.at"), F.col("s.word")
    d = d.select("doc_id", "th", "path", at.alias("word_no"), x.alias("word"), word(at - 2).alias("before2"), word(at - 1).alias("before"), F.coalesce(F.get("w", at + 1), F.lit("")).alias("after"),
                 F.regexp_extract_all("s.word", F.lit(RUN), F.lit(0)).alias("runs"), F.split(x, RUN, -1).alias("gaps"),
                 F.regexp_extract_all("s.word", F.lit(IN_WORD), F.lit(1)).alias("names"), F.regexp_extract_all("s.word", F.lit(IN_WORD), F.lit(2)).alias("values"),
                 F.when(given(at), F.regexp_extract(x, f"^({OPENS}){VALUE}", 2)).when(named(at, x), F.regexp_extract(x, f"^({ASSIGNS}{OPENS}){VALUE}", 2)).otherwise("").alias("split_value"))
    part = lambda lead, candidate: F.struct(lead.alias("lead"), F.regexp_replace(candidate, "\\\\+$", "").alias("candidate"))
    runs = F.transform("runs", lambda c, k: part(F.concat(F.when(k > 0, F.substring(F.get("runs", k - 1), -NEAR, NEAR)).otherwise(""), F.get("gaps", k)), c))
    values = F.transform("values", lambda c, k: part(F.get("names", k), c))
    first = part(F.regexp_extract("word", f"^({ASSIGNS}?{OPENS})", 1), F.col("split_value"))
    more = F.filter(F.concat(values, F.array(first)), lambda s: (s["candidate"] != "") & ~s["candidate"].rlike(f"^{RUN}$"))
    d = d.select("*", F.posexplode(F.concat(runs, more)).alias("candidate_no", "c"))
    return d.select("doc_id", "th", "path", "word_no", "candidate_no", "word", "c.candidate", "before2", "before", "after", "c.lead")


def word_counts(docs: DataFrame) -> DataFrame:
    """How often the corpus uses each lower-case ASCII word; counts combine in the tasks before the shuffle."""
    w = docs.select(F.explode_outer(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("w"))
    return w.where(F.length("w").between(MIN_LETTERS, MIN_LENGTH - 1)).groupBy("w").agg(F.count(F.lit(1)).alias("uses"))


def pair_usage(words: DataFrame) -> DataFrame:
    """``pair, usual``: how usual a letter follows another, as a share of the most usual follower."""
    pairs = words.select("uses", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("pair"))
    p = pairs.groupBy("pair").agg(F.sum("uses").alias("n"))
    most = p.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.max("n").alias("most"))
    return p.join(F.broadcast(most), F.substring("pair", 1, 1) == F.col("a")).select("pair", (F.col("n") / F.col("most")).alias("usual"))  # 26 x 26 pairs at most


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    c = F.col("candidate")
    kind = F.translate(c, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    kind = F.regexp_replace(kind, "[^aA0]", "-")
    n = F.length(c)
    share = lambda k: F.length(F.regexp_replace(kind, f"[^{k}]", "")) / n
    has = lambda text, pattern: F.lower(text).rlike(pattern).cast("double")
    around = F.concat_ws(" ", "before2", "before", "lead")
    f = found.withColumns({
        "length": n.cast("double"), "changes": (F.length(F.regexp_replace(kind, "(a+|A+|0+|-+)", "x")) - 1) / n, "digits": share("0"), "uppers": share("A"), "symbols": share("-"),
        "kinds": sum((share(k) > 0).cast("double") for k in "aA0-"), "path_depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
        "path_sample": has(F.col("path"), SAMPLE_PATHS), "path_config": has(F.col("path"), CONFIG_PATHS),
        "assigned": around.rlike("[=:]").cast("double"), "keyword": has(around, KEYWORDS), "sample_word": has(F.concat_ws(" ", around, c, "after"), SAMPLE_WORDS),
        "quoted": F.col("lead").rlike("[\"'`]").cast("double"), "word_before": F.col("before").rlike("^[A-Za-z]+[.,]?$").cast("double"), "word_after": F.col("after").rlike("^[A-Za-z]+[.,]?$").cast("double"),
    })
    # candidates repeat (copies), so what depends on the candidate alone is joined once for each different one
    alone = f.select("candidate").distinct()
    low = F.lower("candidate")
    piece = alone.select("candidate", F.explode(F.split(low, "[^a-z]+")).alias("w")).where(F.length("w") >= MIN_LETTERS)
    often = words.where(F.col("uses") >= MIN_USES).select("w")
    covered = piece.join(often, "w", "left_semi").groupBy("candidate").agg(F.sum(F.length("w")).alias("covered"))
    pair = alone.select("candidate", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("candidate") - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2)))).alias("pair"))
    usual = pair.join(F.broadcast(pair_usage(words)), "pair", "left").groupBy("candidate").agg(F.avg(F.coalesce("usual", F.lit(0.0))).alias("usual_pairs"))
    f = f.join(covered, "candidate", "left").join(usual, "candidate", "left")
    return f.withColumns({"coverage": F.coalesce(F.col("covered") / F.col("length"), F.lit(0.0)), "usual_pairs": F.coalesce("usual_pairs", F.lit(0.0))}).drop("covered")


def train(labelled: DataFrame, max_findings: int = MAX_FINDINGS):
    """A forest from rows of FEATURES and ``label`` (0 or 1); None without both labels. Copies of a finding count once."""
    use = labelled.where("label in (0, 1)").select("label", *FEATURES).distinct()
    parts = [use.where(F.col("label") == y).orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(max_findings) for y in (0, 1)]
    sample = materialize(parts[0].unionByName(parts[1]))
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), forest]).fit(sample)


def format_label() -> Column:
    """Labels that formats give away: access keys of a known form and values of eight characters or more with digits and letters that a keyword right before them assigns are secrets, words of
    letters alone that nothing is assigned to, words of the dictionary, and parts of addresses, are none; the rest has no label and is left to the forest."""
    c = F.col("candidate")
    around = F.concat_ws(" ", "before2", "before", "lead")
    assigned = around.rlike(f"(?i){NAME}\\s*{ASSIGNS}\\s*{OPENS}$") & (F.length(c) >= 8) & c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    secret = c.rlike("^(AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})$") | assigned
    address = "^[\"'`(<\\[]*([A-Za-z]+:|www\\.|[^\\s@]+@)[^\\s\"'`,;{}]*[\"'`)>\\].,;:]*$"
    inside = F.concat("lead", "candidate").rlike("(://|www\\.)[^\\s\"'`,;{}]*$") | (F.col("word").rlike(address) & F.col("word").rlike("://|@|^www\\."))
    letters = c.rlike("^[A-Za-z]+(-[A-Za-z]+)*$")
    harmless = (letters & ~around.rlike("[=:]")) | (c.rlike("^[A-Za-z]+$") & (F.col("coverage") >= 1)) | inside
    return F.when(secret, 1).when(harmless, 0)


def scan(docs: DataFrame, findings: DataFrame | None = None, path_col: str = "source", cut: float = CUT) -> DataFrame:
    """Every candidate of ``docs(doc_id, text, path_col)``: ``doc_id, word_no, candidate_no, candidate_hash, length, score, is_secret``.

    ``findings``: labelled ones, ``doc_id, word_no, label``, and ``candidate_no`` where it is not the first of the word; without, `format_label` labels what it can. Secrets are returned as a hash alone.
    """
    found = materialize(candidates(docs, path_col))
    words = materialize(word_counts(docs))
    f = features(found, words)
    if findings is None:
        f = f.withColumn("label", format_label())
    else:
        number = F.col("candidate_no").cast("int") if "candidate_no" in findings.columns else F.lit(0)
        f = f.join(findings.select("doc_id", "word_no", number.alias("candidate_no"), F.col("label").cast("int").alias("label")).distinct(), ["doc_id", "word_no", "candidate_no"], "left")
    f = materialize(f)
    model = train(f)
    scored = f.withColumn("score", F.lit(1.0)) if model is None else model.transform(f).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word_no", "candidate_no", F.sha2("candidate", 256).alias("candidate_hash"), F.length("candidate").alias("length"), "score", (F.col("score") >= cut).alias("is_secret"))
