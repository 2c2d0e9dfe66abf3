"""Secret scan with a random forest against false positives, in DataFrame operations only.

Candidates are what is assigned to a name with a credential word, up to the closing quote of the
line or white space, whatever its length and marks; the password of ``user:password@`` in urls;
and runs of at least ``MIN_LENGTH`` letters, digits and ``+ / _ -`` that hold a digit, begin like
an issued key, or follow ``=`` or ``:``. Names, blanks, values and paths may be of any length: the
patterns read from the left with possessive or single-character loops, which Java runs without
recursion and in time linear in the text.

Findings are labelled by evidence that the forest never sees: the credential name, the url, or
the prefix of an issued key against all else. Its features are the length, the transitions
between character classes, how much of the value dictionary words cover, paths (slashes, dots
and file endings in and around it), and the words around the finding, without its name. It is
trained on documents whose crc32 is no multiple of five, and tells how likely a value of such a
shape bears evidence; the rest are held out to measure it (``quality``). A finding with evidence
is removed as a false positive only where the forest gives it less than ``sure``; one without
needs more than ``threshold``. Values shorter than ``MIN_LENGTH``, which the forest has no
counterexamples of, go by their evidence.

Cases: null and empty texts have no candidates; every occurrence in a text is a finding of its
own, also in repeated rows. Without labelled findings of both classes the probability is that
of the label itself (1 or 0), and 0.5 without a label. Null ids stay null and are held out.
``redact`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadlens.llm.workers import is_training_row
from loadlens.session import write_and_read

MIN_LENGTH = 12
AROUND = 48
RUN = "[A-Za-z0-9+/_-]"
# Words that name a credential, and prefixes of issued keys.
CREDENTIAL = r"(?i:passw(?:or)?d|pwd|passphrase|secret|token|api[_-]?key|apikey|auth|credential|private[_-]?key)"
ISSUED = "(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|npm_)"
# A whole name that a sign follows; one of its parts ends with a credential word.
PART = "[A-Za-z0-9_.-]"
CLOSED = r"""\\*+["'\]]*+\h*+"""
NAMED = (rf"(?<!{PART})(?={PART}++{CLOSED}[=:])"
         rf"(?={PART}*?{CREDENTIAL}s?[0-9]*+(?i:key|value|string|text)?+(?![A-Za-z0-9])){PART}++")
LEAD = NAMED + CLOSED + r"""[=:][=>]?+\h*+\\*+(?:["']|(?![=>\\"']|//))"""
VALUE = r"""(?:(?<=")[^"\r\n]++(?=")|(?<=')[^'\r\n]++(?=')|[^\s"']++)"""
STATED = r":[^\\S\\r\\n]*+$"
URL_LEAD = r"""://[^\s/:@"']*+:"""
URL_VALUE = r"""[^\s/"']+(?=@)"""
LONG_RUN = (rf"""(?<!{RUN})(?:(?=[A-Za-z+/_-]*+[0-9])|(?={ISSUED.replace("(", "(?:", 1)})|(?<=[=:]["' ]{{0,2}}))"""
            rf"{RUN}{{{MIN_LENGTH},}}+={{0,2}}")
CANDIDATE = f"{LEAD}{VALUE}|{URL_LEAD}{URL_VALUE}|{LONG_RUN}"
# Groups: text before, lead and value of an assignment, of a url, a run; the last match is empty.
PLACED = rf"(?s)(.*?)(?:({LEAD})({VALUE})|({URL_LEAD})({URL_VALUE})|({LONG_RUN})|\z)"
FEATURES = ["length", "digits", "upper", "lower", "marks", "hex", "turns", "turn_share",
            "letter_digit_turns", "case_turns", "distinct_share", "dictionary", "slashes", "path_before",
            "ending_after", "words_before", "words_after", "line_start"]


def dictionary_words(spark, path: str, shortest: int = 4) -> DataFrame:
    """Whole words of a public word-level vocabulary file: one row each, letters only."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = sorted({w.removesuffix("</w>") for w in vocabulary if w.endswith("</w>")})
    return spark.createDataFrame(pa.table({"word": pa.array(
        [w for w in words if w.isascii() and w.isalpha() and len(w) >= shortest], pa.string())}))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, start, value, kind, before, after) per occurrence; start counts characters
    from 1, kind is ``assigned``, ``stated`` (after a bare colon), ``url`` or ``run``, before and after are up to 48 characters of
    context around the value and its name."""
    text = F.col("t")
    names = ("skip", "name", "assigned", "scheme", "url", "run")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(
        text.rlike(CANDIDATE)).withColumn("all", F.arrays_zip(*[
            F.regexp_extract_all(text, F.lit(PLACED), F.lit(i + 1)).alias(n)
            for i, n in enumerate(names)]))
    # Context reaches back to the finding before and forward into the next one. The outer
    # transform names the matches, so that they are made once, not once for each of them.
    pieces = F.expr(f"""get(transform(array(all), found -> transform(found, (v, i) -> struct(
        length(concat(v.skip, v.name, v.assigned, v.scheme, v.url, v.run)) as length,
        length(concat(v.skip, v.name, v.scheme)) as lead,
        concat(v.assigned, v.url, v.run) as value,
        case when v.url <> '' then 'url' when v.run <> '' then 'run'
             when v.name rlike '{STATED}' then 'stated' else 'assigned' end as kind,
        right(v.skip, {AROUND}) as before,
        left(concat(get(found, i + 1).skip, get(found, i + 1).name, get(found, i + 1).assigned,
                    get(found, i + 1).scheme, get(found, i + 1).url, get(found, i + 1).run), {AROUND}
             ) as after))), 0)""")
    found = found.select("id", F.xxhash64("t").alias("text_hash"), pieces.alias("pieces"),
                         F.monotonically_increasing_id().alias("row"))
    each = found.select("id", "text_hash", "row", F.posexplode("pieces").alias("i", "x")).select(
        "id", "text_hash", "row", "i", "x.*")
    ahead = W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("length").over(ahead), F.lit(0)) + F.col("lead") + 1
    # Marks that escape the closing quote are no part of a value.
    value = F.when(F.col("kind").isin("assigned", "stated") & F.col("after").rlike("""^["']"""),
                   F.regexp_replace("value", r"(?<!\\)\\++$", "")).otherwise(F.col("value"))
    return each.select("id", "text_hash", start.alias("start"), value.alias("value"), "kind",
                       "before", F.coalesce("after", F.lit("")).alias("after")).filter("value <> ''")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES. Only the distinct values meet the dictionary."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    runs = found.select("value").distinct().select("value", F.explode(
        F.regexp_extract_all("value", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("run"))
    covered = runs.join(words, F.lower("run") == F.col("word")).groupBy("value").agg(
        F.sum(F.length("run")).alias("in_words"))
    turns = (_count(v, "(?<=[A-Za-z])(?=[0-9])") + _count(v, "(?<=[0-9])(?=[A-Za-z])"))
    cases = _count(v, "(?<=[a-z])(?=[A-Z])") + _count(v, "(?<=[A-Z])(?=[a-z])")
    marks = _count(v, "(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])") + _count(v, "(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")
    length = F.length(v).cast("double")
    flag = lambda c: c.cast("double")
    return found.join(covered, "value", "left").withColumns({
        "length": length,
        "digits": _count(v, "[0-9]") / length, "upper": _count(v, "[A-Z]") / length,
        "lower": _count(v, "[a-z]") / length, "marks": _count(v, "[^A-Za-z0-9]") / length,
        "hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "turns": turns + cases + marks, "turn_share": (turns + cases + marks) / length,
        "letter_digit_turns": turns, "case_turns": cases,
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))).cast("double") / length,
        "dictionary": F.coalesce(F.col("in_words"), F.lit(0)) / length,
        "slashes": _count(v, "/"), "path_before": flag(before.rlike(r"[/\\.~]$")),
        "ending_after": flag(after.rlike(r"^\.[A-Za-z]{1,5}\b")),
        "words_before": _count(before, r"\S+"), "words_after": _count(after, r"\S+"),
        "line_start": flag(before.rlike(r"(^|\n)\s*$")),
    }).drop("in_words")


def evidence_label(value: Column, kind: Column) -> Column:
    """1 where evidence marks a finding: an issued key's prefix, a password in a url, an
    assignment to a credential name; 0 for placeholders and for findings without evidence; null
    for bare words after a credential word and a colon, as prose has them."""
    prose = (kind == "stated") & value.rlike("^[A-Za-z]++[.,;!?]?$")
    placeholder = value.rlike(r"^(?i:null|none|true|false|undefined)[,;]?$|^\$\{[^}]*+\}$|^<[^>]*+>$|^\*++$")
    return F.when(value.rlike("^" + ISSUED), F.lit(1.0)).when(placeholder, F.lit(0.0)).when(
        prose, F.lit(None)).otherwise((kind != "run").cast("double"))


def train(findings: DataFrame, fit_rows: int = 20_000, trees: int = 20, depth: int = 8):
    """Forest from ``findings`` (FEATURES and label, not null), at most about ``fit_rows`` of
    each class; None unless both classes occur."""
    counts = {r["label"]: r["n"] for r in findings.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if {0.0, 1.0} - set(counts):
        return None
    u = F.pmod(F.xxhash64("value", "before", "start"), F.lit(1 << 30)) / float(1 << 30)
    n = F.when(F.col("label") == 1.0, counts[1.0]).otherwise(counts[0.0])
    own = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(
        findings.filter(u * n < fit_rows))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees,
                                  maxDepth=depth, seed=11).fit(own.select("x", "label"))


def scan(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         label=None, threshold: float = 0.5, sure: float = 0.1, **training) -> DataFrame:
    """(id, text_hash, start, value, kind, label, held_out, score, is_secret) per candidate.

    ``label`` takes the candidates and returns them with a column ``label`` (1, 0 or null), for
    findings that were labelled otherwise; without it evidence labels them.
    """
    found = candidates(docs, id_col, text_col)
    found = write_and_read(label(found) if label else found.withColumn(
        "label", evidence_label(F.col("value"), F.col("kind"))), "secrets")
    found = featured(found, words).withColumn(
        "held_out", ~F.coalesce(is_training_row(F.col("id")), F.lit(False)))
    found = write_and_read(found, "secrets")
    model = train(found.filter("label is not null and not held_out"), **training)
    own = F.coalesce("label", F.lit(0.5))
    if model is None:
        scored = found.withColumn("score", own)
    else:
        x = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found)
        scored = model.transform(x).withColumn("score", F.when(
            F.col("length") < MIN_LENGTH, own).otherwise(
            F.get(vector_to_array("probability"), F.lit(1))))
    least = F.when(F.col("label") == 1.0, sure).otherwise(threshold)
    return scored.select(F.col("id").alias(id_col), "text_hash", "start", "value", "kind", "label",
                         "held_out", "score", (F.col("score") > least).alias("is_secret"))


def quality(scanned: DataFrame) -> DataFrame:
    """One row: labelled findings that were held out, and how many of each kind the scan's
    decision gets right (tp, fp, fn, tn, precision, recall)."""
    said, so = F.col("is_secret"), F.col("label") == 1.0
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return scanned.filter("held_out and label is not null").agg(
        n(said & so).alias("tp"), n(said & ~so).alias("fp"), n(~said & so).alias("fn"),
        n(~said & ~so).alias("tn")).withColumns({
            "precision": F.try_divide("tp", F.col("tp") + F.col("fp")),
            "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of a document replaced where it was found, and values that are
    long or hold letters and digits in all other places of the document, longest values first."""
    secrets = findings.filter("is_secret").groupBy(
        F.col(id_col).alias("id"), F.col("text_hash").alias("own")).agg(
            F.array_sort(F.collect_set(F.struct("start", "value"))).alias("places"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(id_col).alias("key"), F.col(text_col).alias("t"),
                        F.xxhash64(text_col).alias("hash"))
    joined = keyed.join(secrets, (F.col("hash") == F.col("own"))
                        & F.col("key").eqNullSafe(F.col("id")), "left")
    text = F.col("t")

    def cut(a: Column, x: Column) -> Column:
        at = x["start"].cast("int")
        return F.struct((at + F.length(x["value"])).alias("at"), F.concat(
            a["out"], F.substring(text, a["at"], at - a["at"]), F.lit(mark)).alias("out"))

    clean = F.aggregate(
        "places", F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), cut,
        lambda a: F.concat(a["out"], F.substring(text, a["at"], F.length(text))))
    wide = F.array_sort(
        F.filter(F.array_distinct(F.col("places.value")), lambda v: (F.length(v) >= MIN_LENGTH) | (
            F.length(v) >= 6) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")),
        lambda a, b: F.length(b) - F.length(a))
    joined = joined.withColumn("clean", clean)
    clean = F.aggregate(wide, F.col("clean"), lambda t, v: F.replace(t, v, F.lit(mark)))
    return joined.withColumn("t", F.coalesce(clean, text)).select(*[
        (F.col("t") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
