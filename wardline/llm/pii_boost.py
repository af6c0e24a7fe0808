"""Personal data: wide candidate patterns, boosted trees, calibrated thresholds.

DataFrame functions and Spark ML only.  Strict patterns with their checks
give the base spans, which always stay.  One wide pattern per kind proposes
candidates, which may overlap across kinds.  Trees are boosted on format and
context features of all candidates; a candidate that is a base span is a
positive example.  Features are small whole numbers, so the examples are
counted by feature values before training.  On documents held out from
training, each kind gets the lowest threshold above which candidates are as
often right as asked.  Candidates over it that touch no base span are added.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import fold
from wardline.session import checkpoint

KINDS = ["email", "ip", "card", "phone"]
# The stated patterns, written so that they neither back up over long runs nor recurse:
# a run is entered at its first character (or where the last match ended) and never given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The wide patterns of the candidates; \x01 stands for text that a base span covers.
WIDE = {
    "email": r"(?:\G|(?<![^\s@<>()\[\]\x22,;:\x01]))[^\s@<>()\[\]\x22,;:\x01]++@[^\s@<>()\[\]\x22,;:\x01]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:[.][0-9]++){3,}+",
    "card": r"[0-9](?:[\x20._/-]?[0-9]){10,}+",
    "phone": r"(?:\+|\b00|\()?[0-9][\x20()./0-9-]{6,}[0-9]",
}
COVER = "\x01"
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.]0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
CLUES = r"(?i)(mail|contact|tel|phone|call|mobile|fax|card|visa|account|host|server|addr)[^\n]{0,16}$"
SECRETS = r"(?i)(token|key|password|secret|hash|sha|id)[\s=:\x22']*[0-9a-z]*$"
SPAN = "array<struct<s:int,e:int,kind:int>>"
BLOCK = 64


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it, by blocks, in time linear in their count."""
    def total(part):
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def block(b, n=None):
        return F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK) if n is None else n)
    many = F.ceil(F.size(numbers) / BLOCK).cast("int")
    sums = F.transform(F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>")), lambda b: total(block(b)))
    first = F.aggregate(sums, F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("out")),
                        lambda a, x: F.struct((a["t"] + x).alias("t"), F.concat(a["out"], F.array(a["t"])).alias("out")),
                        lambda a: a["out"])
    return F.flatten(F.transform(first, lambda t, b: F.transform(block(b), lambda _, j: t + total(block(b, j)))))


def with_matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: (s, e, m, left, right) of each match; places in code points, the text beside it."""
    m, g, p = f"{out}__m", f"{out}__g", f"{out}__p"
    df = df.withColumns({m: F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), g: F.split(text, pattern, -1)})
    df = df.withColumn(p, sums_before(F.zip_with(m, F.slice(g, 1, F.size(m)), lambda a, b: F.length(a) + F.length(b))))

    # What a function of each element needs comes with the elements: a column named inside
    # the function could be put in its place by the optimizer, and be worked out for each of them.
    def place(x):
        s = x["before"] + F.length(x["gap"])
        return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), F.right(x["gap"], F.lit(24)).alias("left"),
                        F.left(x["next"], F.lit(1)).alias("right"))
    parts = F.arrays_zip(F.col(m).alias("m"), F.col(p).alias("before"), F.slice(g, 1, F.size(m)).alias("gap"), F.slice(g, 2, F.size(m)).alias("next"))
    return df.withColumn(out, F.transform(parts, place)).drop(m, g, p)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def holds(kind: str, m: Column) -> Column:
    """The kind's check on a match of its base pattern."""
    d = digits(m)
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def _holding(kind: str, x: Column) -> Column:
    return holds(kind, x["m"])


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds base_<kind>: (s, e, m, left, right) of the spans that hold."""
    for kind in KINDS:
        df = with_matches(df, text, BASE[kind], f"all_{kind}")
        df = df.withColumn(f"base_{kind}", F.filter(f"all_{kind}", partial(_holding, kind))).drop(f"all_{kind}")
    return df


def spans_of(kind: str, matches: Column) -> Column:
    return F.transform(matches, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("kind")))


# --- features ------------------------------------------------------------------------

def edge(c: Column) -> Column:
    """0: nothing, blank or end; 1: a mark; 2: letter or digit."""
    return F.when((c == "") | c.rlike(r"^[\s\x01]$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(1)


def features(kind: str, x: Column) -> list[Column]:
    """Small whole numbers; how the digits are set apart is left out, so that unusual ways can be found."""
    m, d = x["m"], digits(x["m"])
    size = F.length(d)
    domain = F.regexp_extract(m, r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.([A-Za-z]{2,})$", 1)
    return [
        F.lit(KINDS.index(kind)),
        F.least(size, F.lit(24)),
        m.startswith("+"),
        size.between(14, 19) & F.call_function("luhn_check", d),
        m.rlike(OCTETS),
        edge(F.right(x["left"], F.lit(1))),
        edge(x["right"]),
        F.least(F.length(domain), F.lit(8)),
        x["left"].rlike(CLUES),
        x["left"].rlike(SECRETS),
        F.least(F.length(F.regexp_replace(m, r"[^@]", "")), F.lit(2)),
    ]


def with_candidates(df: DataFrame, text: str, label: bool) -> DataFrame:
    """Adds candidates: (s, e, kind, f, right-or-not) of the wide patterns of all kinds.

    A candidate counts as right if it is a base span of its kind.
    """
    def fields(kind, x):
        return [x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("kind"),
                F.array(*[f.cast("int") for f in features(kind, x)]).alias("f")]

    def plain(kind, x):
        return F.struct(*fields(kind, x))

    def labelled(kind, x, base):
        right = F.array_contains(base, F.struct(x["s"].alias("s"), x["e"].alias("e")))
        return F.struct(*fields(kind, x), right.cast("int").alias("y"))
    for kind in KINDS:
        df = with_matches(df, text, WIDE[kind], f"wide_{kind}")
        wide = F.col(f"wide_{kind}")
        if label:
            base = F.transform(f"base_{kind}", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e")))
            rows = F.zip_with(wide, F.array_repeat(base, F.size(wide)), partial(labelled, kind))
        else:
            rows = F.transform(wide, partial(plain, kind))
        df = df.withColumn(f"cand_{kind}", rows).drop(f"wide_{kind}")
    return df.withColumn("candidates", F.concat(*[f"cand_{k}" for k in KINDS])).drop(*[f"cand_{k}" for k in KINDS])


# --- training ------------------------------------------------------------------------

@dataclass
class Model:
    """Trees as nested (feature, at most, yes, no) or leaf values, their weights, and thresholds by kind."""

    trees: list
    weights: list[float]
    thresholds: list[float | None]

    def probability(self, f: Column) -> Column:
        def value(tree):
            if isinstance(tree, float):
                return F.lit(tree)
            feature, most, yes, no = tree
            return F.when(F.get(f, F.lit(feature)) <= most, value(yes)).otherwise(value(no))
        total = reduce(lambda a, b: a + b, [value(t) * w for t, w in zip(self.trees, self.weights)], F.lit(0.0))
        return 1 / (1 + F.exp(-2 * total))


def tree_of(lines: list[str]):
    """A tree from the lines that Spark prints it as."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    feature, most = re.match(r"If \(feature (\d+) <= ([^)]+)\)", line).groups()
    yes = tree_of(lines)
    lines.pop(0)
    return int(feature), float(most), yes, tree_of(lines)


def trees_of(model: GBTClassificationModel) -> list:
    return [tree_of(t.toDebugString.strip().split("\n")[1:]) for t in model.trees]


def examples(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(held, kind, f, y, n): candidates of all documents, counted by features.

    The number of rows is bounded by the features' ranges.
    """
    some = docs.select((fold(F.col(doc_id), 5) == 0).alias("held"), F.col(text).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    # Outer, as a plain explode adds a filter on the array's size, for which all of it is worked out once more.
    rows = with_candidates(with_base(some, "text"), "text", label=True).select("held", F.explode_outer("candidates").alias("c"))
    return rows.filter("c is not null").groupBy("held", "c.kind", "c.f", "c.y").agg(F.count("*").alias("n"))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 12, depth: int = 4,
          precision: float = 0.95) -> Model:
    """Boosted trees and thresholds; without examples of both sorts nothing is ever added."""
    rows = checkpoint(examples(docs, doc_id, text))
    learn = rows.filter(~F.col("held"))
    if learn.agg(F.count_distinct("y")).first()[0] < 2:
        return Model([], [], [None] * len(KINDS))
    table = learn.select(array_to_vector(F.col("f").cast("array<double>")).alias("features"), F.col("y").cast("double").alias("label"),
                         F.col("n").cast("double").alias("weight")).coalesce(4)
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, weightCol="weight", seed=7, maxBins=32).fit(table)
    model = Model(trees_of(fitted), list(fitted.treeWeights), [None] * len(KINDS))

    # Held-out precision from each score on, in steps of one percent: at most 101 rows per kind.
    step = F.floor(model.probability(F.col("f")) * 100).cast("int")
    bins = (rows.filter("held").groupBy("kind", step.alias("p"))
            .agg(F.sum(F.col("y") * F.col("n")).alias("right"), F.sum("n").alias("all")).collect())
    for kind in range(len(KINDS)):
        for b in sorted((b for b in bins if b["kind"] == kind and b["p"] >= 50), key=lambda b: -b["p"]):
            if b["right"] < precision * b["all"]:
                break
            model.thresholds[kind] = b["p"] / 100
    return model


# --- search --------------------------------------------------------------------------

def covered(text: Column, spans: Column) -> Column:
    """The text with its spans, which are in order and apart, replaced by as many COVER characters."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        spans, start,
        lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(
            F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.repeat(F.lit(COVER), x["e"] - x["s"]))).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    """Spans (s, e, kind) as disjoint (s, e) in order."""
    start = F.array().cast("array<struct<s:int,e:int>>")

    def add(out, x):
        last = F.element_at(out, -1)
        meets = (F.size(out) > 0) & (x["s"] < F.when(F.size(out) > 0, last["e"]).otherwise(0))
        wider = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(meets, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(wider))).otherwise(
            F.concat(out, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))
    return F.aggregate(F.array_sort(spans), start, add)


def find(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text, base and added, arrays of (s, kind, e) in order.

    Places are code points from 0, the end exclusive; kind is a place in
    KINDS.  A null text is empty.  Repeated documents have a row each.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Texts without digit and @ cannot have a span: they are not looked at.
    df = with_base(plain.withColumn("seen", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).otherwise("")), "seen")
    order = lambda spans: F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    df = df.withColumn("spans", F.concat(*[spans_of(k, F.col(f"base_{k}")) for k in KINDS])).drop(*[f"base_{k}" for k in KINDS])
    df = df.withColumn("base", order(F.col("spans")))
    none = F.array().cast("array<struct<s:int,kind:int,e:int>>")
    if all(t is None for t in model.thresholds):
        return df.select("doc_id", "text", "base", none.alias("added"))
    df = with_candidates(df.withColumn("rest", covered(F.col("seen"), joined(F.col("spans")))), "rest", label=False)
    least = F.array(*[F.lit(2.0 if t is None else t) for t in model.thresholds])
    new = F.filter("candidates", lambda c: model.probability(c["f"]) >= F.get(least, c["kind"]))
    return df.select("doc_id", "text", "base", order(new).alias("added"))


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each joined span replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        joined(spans), start,
        lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(
            F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(mark))).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
