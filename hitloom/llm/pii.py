"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

Everything is column expressions over each text, without a shuffle of texts: generators with
high recall propose spans (e-mail-like, number-like, key-like) that may overlap; boosted
trees score each from its format and the characters around it; per generator the least score
that was precise enough on held-out candidates selects.  Spans of fixed formats (e-mail, IP
address, card, phone) are found exactly and always stay.

The trees learn from what the candidates' features do not show: validators (check digits,
part ranges, domains) and key words before a candidate label all candidates of the table; a
third of them is held out for the thresholds.  Candidates with equal features become one row
with a weight, and counts of all of them give the split points, too.

Results: a null text counts as empty and has no spans; repeated rows get the same result
each; without candidates nothing is learned and only the fixed formats are found; positions
count code points, ends exclusive; other columns pass through.  All patterns are possessive,
so a text of n characters takes O(n) steps to search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.store import saved

PRECISION = 0.98
LEAST_POSITIVE = 10
ROUNDS, DEPTH, BINS = 10, 3, 32
CHUNK = 512

# The formats, with the text that any match needs.  A match starts where a run
# of its characters starts or where the match before it ended.
FORMATS = {
    "email": (
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@[A-Za-z0-9-]",
    ),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]"),
}
GENERATORS = {
    "mail": (r"(?<![^\s@])[^\s@]++@[^\s@]++", "[^\\s@]@[^\\s@]"),
    "number": (r"\+?[0-9](?:[ ().-]{0,2}[0-9]){6,}+", r"[0-9](?:[ ().-]{0,2}[0-9]){6}"),
    "key": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", r"[A-Za-z0-9+/_=-]{20}"),
}
KEY_WORDS = r"(?i)(?:token|secret|passw|api.?key|auth|bearer)[^A-Za-z]{0,6}$"
KINDS = [*FORMATS, *GENERATORS]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column) -> Column:
    """Sums of the leading elements of an array<int>, in chunks so that long arrays stay cheap."""

    def sums(part: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), F.array().cast("array<int>").alias("all"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all"))
        return F.aggregate(part, start, step, lambda a: a["all"])

    def chunked(all_values: Column) -> Column:
        count = F.floor((F.size(all_values) - 1) / CHUNK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(all_values, i * CHUNK + 1, F.lit(CHUNK)))
        totals = lambda ps: F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        bases = lambda ps: F.concat(F.array(F.lit(0)), sums(totals(ps), F.lit(0)))
        # The last base is the total of all: no chunk starts there.
        return let(
            parts,
            lambda ps: F.flatten(F.zip_with(ps, F.slice(bases(ps), F.lit(1), F.size(ps)), sums)),
        )

    return let(values, chunked)


_SPAN = "array<struct<start:int,end:int,found:string,before:string,after:string>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """All matches with their positions and up to 24 and 8 characters around them."""

    def placed(found: Column) -> Column:
        def spans(gaps: Column) -> Column:
            lengths = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
            return let(
                running_sums(lengths),
                lambda ends: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(ends, i) - F.length(m)).alias("start"),
                        F.get(ends, i).alias("end"),
                        m.alias("found"),
                        F.right(F.get(gaps, i), F.lit(24)).alias("before"),
                        F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"),
                    ),
                ),
            )

        return F.when(F.size(found) > 0, let(F.split(text, pattern), spans)).otherwise(F.array().cast(_SPAN))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(_SPAN))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _is_ip(found: Column) -> Column:
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int")
    return F.forall(F.split(found, r"\."), lambda p: F.coalesce(number(p) <= 255, F.lit(False)))


def _is_card(found: Column) -> Column:
    return let(_digits(found), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))


def _is_phone(found: Column) -> Column:
    return F.length(_digits(found)).between(9, 15)


_VALID = {"email": lambda m: F.lit(True), "ip": _is_ip, "card": _is_card, "phone": _is_phone}


def format_spans(text: Column) -> Column:
    """Spans of the fixed formats as array<struct<start, rank, end>>; rank counts ``KINDS``."""

    def of(kind: str) -> Column:
        rank, valid = F.lit(KINDS.index(kind)), _VALID[kind]
        found = F.filter(matches(text, *FORMATS[kind]), lambda s: valid(s["found"]))
        return F.transform(found, lambda s: _span(s["start"], rank, s["end"]))

    return F.array_sort(F.concat(*map(of, FORMATS)))


def _span(start: Column, rank: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"))


def candidates(text: Column) -> Column:
    """What the generators propose: array<struct<kind, start, end, found, before, after>>."""

    def of(kind: str) -> Column:
        found = matches(text, *GENERATORS[kind])
        if kind == "key":
            found = F.filter(found, lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]"))
        fields = ("start", "end", "found", "before", "after")
        return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[f].alias(f) for f in fields]))

    return F.concat(*map(of, GENERATORS))


def _label(c: Column) -> Column:
    """Whether validators or the words before a candidate say it is personal."""
    number = (
        _is_card(c["found"])
        | (c["found"].startswith("+") & _is_phone(c["found"]))
        | (c["found"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & _is_ip(c["found"]))
    )
    return (
        F.when(c["kind"] == "mail", c["found"].rlike(FORMATS["email"][0]))
        .when(c["kind"] == "number", number)
        .otherwise(c["before"].rlike(KEY_WORDS))
    )


def features(c: Column) -> Column:
    """Format and context of a candidate as array<double>; nothing of what labels it."""
    count = lambda drop: F.length(F.regexp_replace(c["found"], drop, ""))
    values = [
        *[c["kind"] == kind for kind in GENERATORS],
        F.length(c["found"]),
        count("[^0-9]"),
        count("[^A-Za-z]"),
        count("[^A-Z]"),
        count("[0-9A-Za-z]"),
        count(r"[^.]"),
        count(r"[^ ]"),
        count("[^g-zG-Z]"),
        c["found"].startswith("+"),
        c["found"].rlike(r"[A-Za-z0-9]$"),
        c["before"].rlike(r"[A-Za-z] $"),
        c["before"].rlike(r"[\"'=:]\s*$"),
        c["before"].rlike(r"[0-9.,-]\s*$"),
        c["before"] == "",
        c["after"].rlike(r"^\s*[A-Za-z]"),
        c["after"].rlike("^[\"']"),
        c["after"].rlike(r"^[0-9,.-]"),
    ]
    return F.array(*[v.cast("double") for v in values])


def split_points(rows: DataFrame) -> list[list[float]]:
    """Per feature at most ``BINS - 1`` values that split ``rows`` (x, n) into parts of like weight.

    Between all values where there are few, else where the running count comes nearest to a
    multiple of the stride: the rule of ``pyspark.ml``, but over counts of every row.
    """
    values = rows.select(F.posexplode("x").alias("at", "value"), "n").groupBy("at", "value").agg(F.sum("n").alias("n"))
    ordered = values.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("v"))
    between = lambda a, b: (a["value"] + b["value"]) / 2
    stride = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["n"]) / BINS
    nothing = [F.lit(None).cast("double").alias("value"), F.array().cast("array<double>").alias("cuts")]
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1).alias("next"), *nothing)

    def step(a: Column, x: Column) -> Column:
        target = a["next"] * F.col("stride")
        cut = a["value"].isNotNull() & (F.abs(a["sum"] - target) < F.abs(a["sum"] + x["n"] - target))
        return F.struct(
            (a["sum"] + x["n"]).alias("sum"),
            (a["next"] + cut.cast("int")).alias("next"),
            x["value"].alias("value"),
            F.when(cut, F.concat(a["cuts"], F.array(between(a, x)))).otherwise(a["cuts"]).alias("cuts"),
        )

    every = F.transform(F.slice("v", F.lit(2), F.size("v")), lambda x, i: between(F.get("v", i), x))
    cuts = F.when(F.size("v") <= BINS, every).otherwise(F.aggregate("v", start, step, lambda a: a["cuts"]))
    found = ordered.withColumn("stride", stride).select("at", cuts.alias("cuts")).collect()
    return [list(row.cuts) for row in sorted(found)]


def binned(x: Column, cuts: list[list[float]]) -> Column:
    """Of each feature the number of its split points that lie below it."""
    below = lambda i, own: sum(((F.get(x, F.lit(i)) > F.lit(c)).cast("double") for c in own), F.lit(0.0))
    return F.array(*[below(i, own) for i, own in enumerate(cuts)])


def _tree(node, x: Column, cuts: list[list[float]]) -> Column:
    """A tree over binned features as a column over the features ``x`` themselves."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = _tree(node.leftChild(), x, cuts), _tree(node.rightChild(), x, cuts)
    at = split.featureIndex()
    return F.when(F.get(x, F.lit(at)) <= F.lit(cuts[at][int(split.threshold())]), left).otherwise(right)


class Model:
    """Boosted trees as a column expression, and a least score per generator."""

    def __init__(self, trees: list[tuple[float, object]], least: dict[str, float], cuts: list[list[float]] = ()):
        self.trees, self.least, self.cuts = trees, least, cuts

    def score_of(self, x: Column) -> Column:
        margin = sum((F.lit(w) * _tree(root, x, self.cuts) for w, root in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def score(self, candidate: Column) -> Column:
        return let(features(candidate), self.score_of)

    def selects(self, candidate: Column) -> Column:
        least = F.lit(2.0)
        for kind, value in self.least.items():
            least = F.when(candidate["kind"] == kind, F.lit(value)).otherwise(least)
        return self.score(candidate) >= least


def least_scores(rows: list[tuple], precision: float = PRECISION) -> dict[str, float]:
    """Per generator the least score from which on held-out candidates are precise enough.

    Rows are (kind, score, label), or (kind, score, label, n) for n equal ones.
    """
    found = {}
    for kind in {row[0] for row in rows}:
        own = sorted(((score, label, *n) for k, score, label, *n in rows if k == kind), reverse=True)
        right = total = 0
        for i, (score, label, *n) in enumerate(own, 1):
            count = n[0] if n else 1
            right, total = right + label * count, total + count
            last = i == len(own) or own[i][0] < score  # equal scores are selected together
            if last and right >= LEAST_POSITIVE and right >= precision * total:
                found[kind] = score
    return found


def fit(df: DataFrame, text: Column) -> Model:
    """Learn trees and thresholds from all candidates in ``df``."""
    proposed = df.select(F.explode(candidates(F.coalesce(text, F.lit("")))).alias("c"))
    c = F.col("c")
    held = F.pmod(F.shiftright(F.xxhash64("c.found", "c.before", "c.start"), 7), F.lit(3)) == 0
    rows = proposed.select(c["kind"].alias("kind"), features(c).alias("x"), _label(c).cast("double").alias("label"), held.alias("held"))
    rows = saved(rows.groupBy("kind", "x", "label", "held").agg(F.count("*").alias("n")), "candidates")
    learn = rows.where("not held")
    if learn.agg(F.count_distinct("label")).first()[0] < 2:
        return Model([], {})
    cuts = split_points(learn)
    learn = learn.groupBy(binned(F.col("x"), cuts).alias("x"), "label").agg(F.sum("n").cast("double").alias("n"))
    learn = saved(learn, "binned").select(array_to_vector("x").alias("features"), "label", "n")
    fitted = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, maxBins=BINS, seed=1, weightCol="n").fit(learn)
    trees = [(w, t._call_java("rootNode")) for w, t in zip(fitted.treeWeights, fitted.trees)]
    model = Model(trees, {}, cuts)
    score = model.score_of(F.col("x")).alias("score")
    scored = rows.where("held").select("kind", score, (F.col("label") > 0).alias("label"), "n")
    # The driver gets one row per score, and there are as many as ways through the trees.
    counted = scored.groupBy("kind", "score", "label").agg(F.sum("n").alias("n"))
    model.least = least_scores([tuple(r) for r in counted.collect()])
    return model


def with_spans(df: DataFrame, text: Column, model: Model, into: str = "pii") -> DataFrame:
    """``df`` with a struct: ``base`` spans of the fixed formats, and all ``spans``.

    A selected candidate that meets a base span or an earlier selected one is left out.
    """
    body = F.coalesce(text, F.lit(""))
    base = format_spans(body)
    if not model.trees or not model.least:
        return df.withColumn(into, let(base, lambda b: F.struct(b.alias("base"), b.alias("spans"))))
    chosen = F.transform(
        F.filter(candidates(body), model.selects),
        lambda c: _span(c["start"], F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int") - 1, c["end"]),
    )
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    apart = lambda b: F.filter(chosen, lambda c: ~F.exists(b, lambda s: meets(c, s)))

    def first_of_each(spans: Column) -> Column:
        keep = lambda kept, c: F.when(F.exists(F.slice(kept, -1, 1), lambda s: meets(c, s)), kept).otherwise(F.concat(kept, F.array(c)))  # noqa: E731, E501
        return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,rank:int,end:int>>"), keep)

    pii = let(
        base,
        lambda b: let(
            apart(b),
            lambda more: F.struct(b.alias("base"), F.array_sort(F.concat(b, first_of_each(more))).alias("spans")),
        ),
    )
    return df.withColumn(into, pii)


def named(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    text = lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with ``[KIND]`` in place of each span; overlapping spans become one."""
    kinds = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        mask = F.when(s["start"] >= a["at"], F.get(kinds, s["rank"])).otherwise("")
        return F.struct(F.concat(a["out"], between, mask).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    finish = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
