"""Personal data by candidate gradient boosting, in SQL functions only.

Base spans come from fixed patterns. High-recall generators propose more spans,
which may overlap. Boosted trees over format and context features, fitted on
all candidates that the base rules decide, score the ones that they
do not; thresholds calibrated on held-back candidates select what is added. The
fitted trees become a column expression, so detection needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.columns import folded, let, pieces
from sessionmill.llm.session import prepare, stored

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
CANDIDATE = "array<struct<start:bigint,kind:int,end:bigint,label:int,features:array<double>>>"

# Possessive forms of the base patterns: they find the same spans in time linear in the text.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A card's digits may have one space or dash between two of them: every other space and dash is replaced first.
LOOSE_SEPARATOR = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
CARD = r"[0-9][0-9\x20-]{13,}+"

# Generators of candidates: written-out addresses, grouped digits, and four grouped numbers.
LABEL, AT, DOT = "[A-Za-z0-9-]{1,63}+", r"(?: ?[\[(]at[\])] ?| at )", r"(?: ?[\[(]dot[\])] ?| dot )"
SPELT = rf"(?<!{LOCAL}){LOCAL}{{1,64}}+(?:@{LABEL}(?:\.{LABEL}){{0,8}}|{AT}{LABEL}(?:\.{LABEL}){{0,3}}{DOT}{LABEL}(?:(?:\.|{DOT}){LABEL}){{0,3}})"
GROUPED = r"(?<![0-9A-Za-z])[+(]?[0-9][0-9\x20()./-]{6,28}[0-9](?![0-9A-Za-z])"
QUARTET = r"(?<![0-9.])[0-9]{1,3}(?:[.:,][0-9]{1,3}){3}(?![0-9.])"
CUES = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|credit|account|ip|host|addr|server)[^a-z]*$"
CONTEXT = 24
#: Values of a feature that trees tell apart; Spark takes splits from all rows if they are at most the square of it.
MOST_BINS = 1024


#: A match with its context: what stands right before it, since the match before, and the character after it.
FOUND = "struct<start:bigint,end:bigint,value:string,before:string,after:string>"


def spans(text: Column, pattern: str) -> Column:
    """(start, end, value) of each match, in code points, from the matches and what lies between them."""

    def listed(parts: Column) -> Column:
        def step(acc: Column, i: Column) -> tuple[dict[str, Column], Column, Column]:
            start = (acc["at"] + F.length(F.get(parts, i - 1))).cast("bigint")
            end = (start + F.length(F.get(parts, i))).cast("bigint")
            return {"at": end}, F.struct(start.alias("start"), end.alias("end"), F.get(parts, i).alias("value"), F.right(F.get(parts, i - 1), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(1)).alias("after")), F.lit(True)

        grown = folded(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), FOUND, {"at": F.lit(0).cast("bigint")}, step)
        return F.when(F.size(parts) > 1, grown["out"]).otherwise(F.array().cast(f"array<{FOUND}>"))

    return let(pieces(text, pattern), listed)


def packed(span: Column) -> Column:
    """A span as one number, which is quick to look for."""
    return F.shiftleft(span["start"] * len(KINDS) + span["kind"], 24) + (span["end"] - span["start"]) % (1 << 24)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.try_cast("int"))).otherwise(d.try_cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def small_parts(value: Column) -> Column:
    """Whether every number in a dotted quartet is at most 255, however long it is written."""
    return F.forall(F.split(value, "[^0-9]"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))


def _gated(gate: Column, value: Column) -> Column:
    return F.when(gate, value).otherwise(F.array().cast(f"array<{FOUND}>"))


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds ``base``: the valid base spans in order of start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn("_text", text).withColumn("_cards", F.when(F.col("_text").rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), F.regexp_replace("_text", LOOSE_SEPARATOR, "\u0001")))
    email = _gated(F.col("_text").contains("@"), spans(F.col("_text"), EMAIL))
    ip = _gated(F.col("_text").rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), spans(F.col("_text"), IP))
    phone = _gated(F.col("_text").rlike(r"\+[0-9]"), spans(F.col("_text"), PHONE))
    card = _gated(F.col("_cards").isNotNull(), spans(F.col("_cards"), CARD))
    n = lambda s: F.length(digits(s["value"]))
    valid = [
        _of_kind(email, "email"),
        _of_kind(F.filter(ip, lambda s: small_parts(s["value"])), "ip"),
        _of_kind(F.filter(card, lambda s: n(s).between(14, 19) & luhn(F.when(n(s) <= 19, digits(s["value"])).otherwise(F.lit("1")))), "card"),
        _of_kind(F.filter(phone, lambda s: n(s).between(10, 15)), "phone"),
    ]
    return marked.withColumn("base", F.array_sort(F.concat(*valid)).cast(SPAN))


FEATURES = ("kind", "length", "digits", "separators", "separator_kinds", "luhn", "small_parts", "cue", "edge_before", "edge_after", "groups", "longest_group", "dots")


def _features(s: Column, kind: str) -> Column:
    """Format and context of a span; whether the base rule holds is not among them."""
    value, number = s["value"], digits(s["value"])
    groups = F.filter(F.split(value, "[^0-9A-Za-z]+"), lambda g: g != "")
    before, after = s["before"], s["after"]
    flag = lambda c: c.cast("double")
    return F.array(
        F.lit(float(KINDS.index(kind))),
        F.length(value).cast("double"),
        F.length(number).cast("double"),
        F.length(F.regexp_replace(value, r"[^\x20().:/,-]", "")).cast("double"),
        F.size(F.array_distinct(F.split(F.regexp_replace(value, r"[^\x20().:/,-]", ""), ""))).cast("double"),
        flag(luhn(F.when(F.length(number).between(8, 19), number).otherwise(F.lit("1")))),
        flag(small_parts(value)),
        flag(before.rlike(CUES)),
        flag(before.rlike("[A-Za-z0-9]$")),
        flag(after.rlike("^[A-Za-z0-9]")),
        F.size(groups).cast("double"),
        F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double"),
        (F.length(value) - F.length(F.replace(value, F.lit("."), F.lit("")))).cast("double"),
    )


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds ``base`` and ``candidates``: proposed spans with features and what the base rules say of them.

    Label 1: a base span. Label 0: of a form that the kind never has (too few or
    too many digits, a failed check sum, a number over 255, an @ without a dotted host). Null: undecided.
    """
    df = with_base(docs)
    text = F.col("_text")
    spelt = _gated(text.contains("@") | text.rlike(r"[\[( ]dot[\]) ]"), spans(text, SPELT))
    grouped = _gated(text.rlike(r"[0-9][0-9\x20()./-]{6}"), spans(text, GROUPED))
    quartet = _gated(text.rlike(r"[0-9][.:,][0-9]{1,3}[.:,][0-9]{1,3}[.:,][0-9]"), spans(text, QUARTET))
    df = df.withColumns({"_spelt": spelt, "_grouped": grouped, "_quartet": quartet, "_known": F.transform("base", packed)})
    # what cannot be of the kind; not all of it is in reach of the features
    impossible = {
        "email": lambda s: s["value"].contains("@"),
        "ip": lambda s: ~small_parts(s["value"]),
        "card": lambda s: ~F.length(digits(s["value"])).between(14, 19) | ~luhn(F.when(F.length(digits(s["value"])) <= 19, digits(s["value"])).otherwise(F.lit("1"))),
        "phone": lambda s: ~F.length(digits(s["value"])).between(10, 15),
    }

    def proposed(column: str, kind: str) -> Column:
        def row(s: Column) -> Column:
            span = F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"))
            label = F.when(F.array_contains(F.col("_known"), packed(span)), 1).when(impossible[kind](s), 0)
            return F.struct(*[span[n].alias(n) for n in ("start", "kind", "end")], label.alias("label"), _features(s, kind).alias("features"))

        return F.transform(F.col(column), row)

    every = F.concat(proposed("_spelt", "email"), proposed("_quartet", "ip"), proposed("_grouped", "card"), proposed("_grouped", "phone"))
    return df.withColumn("candidates", every.cast(CANDIDATE)).drop("_cards", "_spelt", "_grouped", "_quartet", "_known")


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, threshold, left, right) or leaf values, their weights, and each kind's threshold."""

    trees: tuple
    weights: tuple
    thresholds: tuple

    def score(self, features: Column) -> Column:
        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(F.get(features, F.lit(feature)) <= threshold, value(left)).otherwise(value(right))

        margin = sum((F.lit(w) * value(t) for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def adds(self, c: Column) -> Column:
        """Whether an undecided candidate is selected."""
        threshold = F.get(F.array(*map(F.lit, self.thresholds)), c["kind"])
        return c["label"].isNull() & (self.score(c["features"]) >= threshold) if self.trees else F.lit(False)


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def fit(docs: DataFrame, rounds: int = 12, depth: int = 3, precision: float = 0.98) -> Model:
    """Fits the trees on all decided candidates of all documents.

    Features are small numbers, so candidates that are equal in all of them are one row with
    their number as its weight; both labels weigh the same together. One in four is held
    back, by hash; a kind's threshold is the least score above which the held-back
    candidates reach ``precision``. Without candidates of both labels
    there is no model, and nothing is added to the base spans.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = with_candidates(docs).select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*").where("label IS NOT NULL")
    held = (F.pmod(F.xxhash64("doc_id", "start", "kind", "end"), F.lit(4)) == 0).alias("held")
    counted = found.groupBy("kind", "label", "features", held).agg(F.count("*").alias("n"))
    counted = stored(counted.orderBy("held", "label", "features"), "counted")
    train = counted.where("NOT held")
    of_label = {r.label: r.n for r in train.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(of_label) < 2:
        return Model((), (), (1.1,) * len(KINDS))
    weight = F.col("n") * F.when(F.col("label") == 1, sum(of_label.values()) / 2 / of_label[1]).otherwise(sum(of_label.values()) / 2 / of_label[0])
    boosted = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth, seed=1, maxBins=MOST_BINS, weightCol="weight").fit(train.select("label", weight.alias("weight"), array_to_vector("features").alias("vector")))
    trees = tuple(_tree(t.rootNode()) for t in boosted._java_obj.trees())
    model = Model(trees, tuple(float(w) for w in boosted.treeWeights), (0.5,) * len(KINDS))
    bins = counted.where("held").select("kind", "label", "n", F.floor(model.score(F.col("features")) * 50).alias("bin")).groupBy("kind", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    thresholds = []
    for kind in range(len(KINDS)):
        own = sorted(((r.bin, r.good, r.n) for r in bins if r.kind == kind), reverse=True)
        best, good, n = 0.9, 0, 0
        for at, g, m in own:
            good, n = good + g, n + m
            if good >= precision * n:
                best = at / 50
        thresholds.append(max(best, 0.5))
    return Model(trees, tuple(float(w) for w in boosted.treeWeights), tuple(thresholds))


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """Adds to ``docs``: base and spans, arrays of (start, kind, end) in order of start, then kind.

    Null texts are as empty. Rows are treated one by one, so repeated rows, null
    ids and extra columns pass through (columns of these names, and candidates,
    are replaced); an empty table gives an empty result.
    """
    df = with_candidates(docs)
    # an undecided candidate is no base span, and each generator finds a place once
    more = F.transform(F.filter("candidates", model.adds), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return df.withColumn("spans", F.array_sort(F.concat("base", more.cast(SPAN)))).drop("_text", "candidates")


def told(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def redacted(df: DataFrame) -> DataFrame:
    """The text with each run of overlapping spans replaced by its first span's kind in brackets."""
    name = F.array(*map(F.lit, KINDS))

    def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column, Column]:
        gap = F.substring(F.col("text"), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        return {"at": F.greatest(acc["at"], s["end"])}, F.concat(gap, F.lit("["), F.get(name, s["kind"]), F.lit("]")), s["start"] >= acc["at"]

    def finished(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text")))

    done = let(folded(F.col("spans"), "string", {"at": F.lit(0).cast("bigint")}, step), finished)
    return df.withColumn("text", F.when((F.size("spans") > 0) & F.col("text").isNotNull(), done).otherwise(F.col("text")))


def base_columns(found: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 of documents with ``base``, and ``more``."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), *more)


def personal_data(docs: DataFrame) -> DataFrame:
    """Fits on ``docs`` and tells each document's personal data: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans, repeated rows a result each; a null doc_id
    stays null, other columns are ignored, and an empty table gives an empty result.
    The bounds of the generators (64 characters before an @, 6 to 28 between the
    first and last digit of a group) hold for added spans only: base spans have none.
    """
    model = fit(docs)
    found = detect(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model)
    return base_columns(found, told(F.col("spans")).alias("spans"))
