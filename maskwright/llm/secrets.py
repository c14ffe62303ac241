"""Secret scanning: a random forest removes false positives, in column expressions and Spark ML only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import WHITE, stored
from maskwright.session import with_once

#: A run of key characters that has a digit, at least 12 long.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}"
#: Public forms of vendors' keys, which are secrets wherever they stand, and forms that are not.
KNOWN_SECRET = "^(" + "|".join([
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[opsru]_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[A-Za-z0-9_-]{20}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"ya29\.[A-Za-z0-9_-]{20,}",
    r"[rs]k_live_[A-Za-z0-9]{16,}",
    r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[A-Za-z0-9_-]{50,}",
    r"hf_[A-Za-z0-9]{34}",
    r"dop_v1_[0-9a-f]{64}",
    r"shpat_[0-9a-f]{32}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
]) + ")$"
KNOWN_HARMLESS = r"^([0-9+/_-]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(.)\2+.{0,3}|.*(?i)(example|placeholder|changeme|xxxx|dummy).*)$"
ASSIGNED = r"(?i)(pass(word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer)[a-z_]*[\"']?\s*(=|:|=>|is)\s*[\"']?$"
NAMED_HARMLESS = r"(?i)(commit|sha1?|sha256|md5|checksum|digest|hash|uuid|guid|order|invoice|isbn|card|phone|rev(ision)?|etag)[a-z_]*[\"']?\s*(=|:|#|\s)\s*[\"']?$"

#: A known secret form inside any text, digit or not.
KNOWN = f"(?<![A-Za-z0-9]){KNOWN_SECRET.strip('^$')}(?![A-Za-z0-9])"
#: A name of a secret with the run it stands in, and its value: to the closing quote, or to white space.
NAME = r"(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer)"
VALUE = r"(?:(?<=\")[^\"\r\n]+(?=\"|$)|(?<=')[^'\r\n]+(?='|$)|[^\s\"']\S*)"
ASSIGNMENT = rf"((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]*?{NAME}(?i:[a-z_]*)[\"']?\s*(?i:=>|=|:|is(?![a-z]))\s*[\"']?)({VALUE})"
CANDIDATE = f"{ASSIGNMENT}|{KNOWN}|{RUN}"
#: What closes a value without quotes, and its part before a further field.
CLOSING, FIELD = r"[\"',;)\]}>]+$", r"^([^&;,]+)[&;,].*=.*$"

CLASSES = "ULDS"
PAIRS = [a + b for a in CLASSES for b in CLASSES]
#: Features of the words before a candidate, by which rules label it.
CUES = ["assigned", "named_harmless", "glued", "quoted", *(f"last_{i}" for i in range(8))]


def _inner(whole: Column, at: Column, own: bool = False) -> Column:
    """(candidate, at) of the runs, known forms and assigned values inside a text that starts at `at`; the text itself only with own."""
    hits = F.flatten(F.array(*[F.regexp_extract_all(whole, F.lit(p), F.lit(g)) for p, g in ((RUN, 0), (KNOWN, 0), (ASSIGNMENT, 2), (FIELD, 1))]))
    hits = F.filter(F.array_distinct(hits), lambda x: x != "" if own else (x != whole) & (x != ""))
    return F.transform(hits, lambda x: F.struct(x.alias("candidate"), (at + F.instr(whole, x) - 1).alias("at")))


def _candidates(match: Column, i: Column) -> Column:
    """(candidate, at, i) of a match: the value of an assignment or the match itself, and what stands inside."""
    name, raw = F.regexp_extract(match, f"^{ASSIGNMENT}$", 1), F.regexp_extract(match, f"^{ASSIGNMENT}$", 2)
    trimmed = F.regexp_replace(raw, CLOSING, "")
    quoted = name.rlike("[\"']$")
    value = F.when(quoted | (trimmed == ""), raw).otherwise(trimmed)
    at = F.length(name)
    whole = lambda c, at: F.array(F.struct(c.alias("candidate"), at.alias("at")))
    all_ = F.when(raw == "", F.concat(whole(match, F.lit(0)), _inner(match, F.lit(0)))).otherwise(F.concat(_inner(name, F.lit(0), own=True), whole(value, at), _inner(value, at)))
    return F.transform(all_, lambda x: F.struct(x["candidate"].alias("candidate"), x["at"].alias("at"), i.alias("i")))


def findings(documents: DataFrame, context: int = 60, path: str = "source") -> DataFrame:
    """Candidates of each whole text: (doc_id, path, number, candidate, before, after), number from 1 in text order.

    Runs of key characters, known secret forms and values assigned to names of secrets; what stands inside a longer
    candidate follows it, and what repeats inside one counts once. The whole text is searched once, and cut only where
    something was found.
    """
    text = F.coalesce("text", F.lit(""))
    texts = documents.select("doc_id", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), text.alias("text"))
    parts = with_once(texts, hits=F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).filter("size(hits) > 0")
    parts = parts.withColumn("gaps", F.split("text", CANDIDATE, -1)).drop("text")
    each = parts.select("doc_id", "path", "gaps", "hits", F.posexplode(F.flatten(F.transform("hits", _candidates))).alias("place", "c"))
    each = each.select("doc_id", "path", (F.col("place") + 1).alias("number"), "c.candidate", "c.at", F.expr("gaps[c.i]").alias("gap"), F.expr("hits[c.i]").alias("hit"), F.expr("gaps[c.i + 1]").alias("next"))
    return each.select(
        "doc_id", "path", "number", "candidate", F.expr(f"right(concat(gap, left(hit, at)), {context})").alias("before"),
        F.expr(f"left(concat(substring(hit, at + length(candidate) + 1), next), {context})").alias("after"))


def grams(word: Column, n: int = 4) -> Column:
    """All runs of n characters, lower case."""
    low = F.lower(word)
    return F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def dictionary(documents: DataFrame, size: int = 2000) -> list[str]:
    """The `size` 4-letter runs that start words in most texts, over all texts: a bounded model of ordinary words."""
    starts = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![^\x20\x09-\x0D])\p{L}{4}"), F.lit(0))
    counted = documents.select(F.explode(F.array_distinct(starts)).alias("gram")).groupBy("gram").count()
    return [r["gram"] for r in counted.orderBy(F.desc("count"), "gram").limit(size).collect()]


def features(found: DataFrame, known: list[str]) -> tuple[DataFrame, list[str]]:
    """found with a number per feature: length, character classes and their transitions, dictionary coverage, path and neighbours."""
    c = F.col("candidate")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "#"), "[A-Z]", "U"), "[a-z]", "L"), "[0-9]", "D")
    base = with_once(found, kinds=F.regexp_replace(kinds, "#", "S"), grams=grams(c), n=F.length(c).cast("double"),
                     last=F.lower(F.regexp_extract("before", r"(\S+)\s*$", 1)), first=F.lower(F.regexp_extract("after", r"^\s*(\S+)", 1)))
    columns: dict[str, Column] = {"length": F.col("n")}
    for k in CLASSES:
        columns[f"share_{k}"] = (F.col("n") - F.length(F.replace("kinds", F.lit(k), F.lit("")))) / F.col("n")
    for pair in PAIRS:
        columns[f"move_{pair}"] = (F.col("n") - F.length(F.replace("kinds", F.lit(pair), F.lit("")))) / F.col("n")
    listed = F.array(*[F.lit(g) for g in known]) if known else F.array().cast("array<string>")
    columns["coverage"] = F.size(F.array_intersect("grams", listed)) / F.greatest(F.size("grams"), F.lit(1))
    columns["distinct"] = F.size(F.array_distinct(F.split("candidate", ""))) / F.least(F.col("n"), F.lit(36.0))
    columns["hex"] = F.col("candidate").rlike("^[0-9a-f]+$").cast("double")
    columns["padded"] = F.col("candidate").endswith("=").cast("double")
    columns["slashes"] = F.size(F.split("candidate", "/")).cast("double")
    columns["path_code"] = F.col("path").rlike(r"(?i)\.(py|js|java|go|rb|env|ya?ml|json|conf|ini|sh)$").cast("double")
    columns["path_test"] = F.col("path").rlike(r"(?i)(test|example|sample|mock|fixture|doc)").cast("double")
    columns["assigned"] = F.col("before").rlike(ASSIGNED).cast("double")
    columns["named_harmless"] = F.col("before").rlike(NAMED_HARMLESS).cast("double")
    columns["glued"] = F.col("before").rlike(r"\S$").cast("double")
    columns["quoted"] = F.col("before").rlike(r"[\"']$").cast("double")
    for i in range(8):
        columns[f"last_{i}"] = (F.pmod(F.xxhash64("last"), F.lit(8)) == i).cast("double")
        columns[f"first_{i}"] = (F.pmod(F.xxhash64("first"), F.lit(8)) == i).cast("double")
    return base.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()}).drop("kinds", "grams", "n", "last", "first"), list(columns)


def label_findings(found: DataFrame) -> DataFrame:
    """found with label 1 (known secret form, or assigned to a name of a secret), 0 (known harmless form or name), null (open).

    by_context: the words before gave the label and not the candidate's own form.
    """
    c, before = F.col("candidate"), F.col("before")
    prose = before.rlike("(?i)is\\s*$") & c.rlike(r"^\p{L}+[.,!?]*$")  # 'the secret is out'
    form, plain = c.rlike(KNOWN_SECRET), c.rlike(KNOWN_HARMLESS)
    label = F.when(form | (before.rlike(ASSIGNED) & ~plain & ~prose), 1.0).when(plain | before.rlike(NAMED_HARMLESS), 0.0)
    return found.withColumns({"label": label, "by_context": label.isNotNull() & ~form & ~plain})


def without_cues(labelled: DataFrame) -> DataFrame:
    """labelled with the CUES of those rows blanked whose label comes from them: the forest learns such labels from all the rest.

    So the words before a candidate are learned from findings whose form gives the label, and forms from those whose
    neighbours give it.
    """
    return labelled.withColumns({c: F.when(F.col("by_context"), 0.0).otherwise(F.col(c)) for c in CUES})


def train(labelled: DataFrame, names: list[str], trees: int = 24, depth: int = 8, sample: int = 40_000, seed: int = 3) -> RandomForestClassificationModel | None:
    """A forest on labelled findings (label 0 or 1, one column per name), at most about `sample` drawn by hash; None unless both labels occur."""
    known = labelled.filter("label is not null")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    share = min(1.0, sample / sum(sizes.values()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", "number", "sha256"), F.lit(1 << 20)) < share * (1 << 20))
    weight = F.lit(sum(sizes.values()) / 2.0) / F.when(F.col("label") == 1.0, F.lit(float(sizes[1.0]))).otherwise(F.lit(float(sizes[0.0])))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(drawn.withColumn("weight", weight)).select("features", "label", "weight")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", maxMemoryInMB=128).fit(rows)


def scan(documents: DataFrame, labelled: DataFrame | None = None, dictionary_size: int = 2000) -> DataFrame:
    """Every candidate of every whole text with the forest's score.

    labelled: findings with doc_id, path, number, candidate, before, after, label, as findings() makes them; by default
    those that known forms and the words before label (label_findings), the latter without_cues. Returns doc_id, number,
    n_chars, sha256 of the candidate, masked (its first third, at most four characters), score, is_secret. A candidate
    itself is neither returned nor written anywhere. Null texts have no candidates; null
    ids and paths pass through as they are and as empty; equal rows give equal findings. Without labels of both kinds
    the score is null and every candidate counts as a secret.
    """
    known = dictionary(documents, dictionary_size)
    sha256 = F.sha2("candidate", 256).alias("sha256")
    masked = F.concat(F.expr("left(candidate, least(4, cast(length(candidate) / 3 as int)))"), F.lit("...")).alias("masked")
    found, names = features(label_findings(findings(documents)), known)
    found = stored(found.select("doc_id", "number", F.length("candidate").cast("long").alias("n_chars"), sha256, masked, "label", "by_context", *names))
    taught = without_cues(found) if labelled is None else features(labelled, known)[0].withColumn("sha256", sha256)
    model = train(taught, names)
    if model is None:
        scored = found.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(found)).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.select("doc_id", "number", "n_chars", "sha256", "masked", "score", F.coalesce(F.col("score") >= 0.5, F.lit(True)).alias("is_secret"))
