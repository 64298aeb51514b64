import hashlib
import random
import re

from pyspark.sql import functions as F

from hitloom.llm import pii
from hitloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
# The formats as stated, without possessive forms or shortcuts.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(values) % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), rank, m.end()))
    return sorted(spans)


def joined(spans):
    return ",".join(f"{pii.KINDS[rank]}:{a}:{b}" for a, rank, b in spans)


ODD = [
    None, "", "a@b.c", "a@b.c_d@e.f x@y", "😀 é a.b%c+d@x-y.co.uk. z", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.000.1.01 999999999999999999999.1.1.1",
    "4111 1111-1111 1111", "4111  1111", "+1 (555) 123-4567) +12 +1((((((", "+1 +2 345 678 901 2", "4111111111111111 4111111111111112",
    "1" * 5000, "a" * 5000, "a@" + "b." * 5000 + "c", "4111111111111111", "4111111111111111", ("x@y.zz 10.0.0.1 " * 1500),
]


def texts(n):
    rng = random.Random(5)
    parts = ["@", ".", "-", " ", "+", "1", "25", "4111111111111111", "a", "B_", "é", "😀", "(", ")", "x@y.z", "10.1.2.3", "+1 555 555 5555", "\n", '"']
    return ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(n)]


def test_formats_against_brute_force(spark):
    cases = ODD + texts(1500)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(cases)], "doc_id long, text string, spans int")
    got = pii.with_spans(df, F.col("text"), pii.Model([], {})).select("doc_id", pii.named(F.col("pii")["base"]).alias("s")).collect()
    assert len(got) == len(cases)
    for row in got:
        assert row.s == joined(brute(cases[row.doc_id])), cases[row.doc_id][:200]
    assert pii.with_spans(df.limit(0), F.col("text"), pii.Model([], {})).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (1, 2, 511, 512, 513, 1024, 3000)], "v array<int>")
    for row in df.select("v", pii.running_sums(F.col("v")).alias("s")).collect():
        assert row.s == [sum(row.v[: i + 1]) for i in range(len(row.v))]


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op5_pii"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        want, row = brute(doc.text), got[doc.doc_id]
        assert row.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(r == k for _, r, _ in want) for k in range(4)]
        assert set(joined(want).split(",")) - {""} <= set(row.spans.split(","))


def test_learned_spans_and_redaction(spark):
    rng = random.Random(1)
    token = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    rows = [(f'api token = "{token()}" ok',) for _ in range(150)] + [(f"see /path/{rng.randrange(9)}/long-name-of-some-file-{i} ok",) for i in range(150)]
    df = spark.createDataFrame(rows + [("mail a@b.co now, a@b.co",), (None,), ("",)], "text string")
    model = pii.fit(df, F.col("text"))
    out = pii.with_spans(df, F.col("text"), model).select("text", "pii.spans", pii.redacted(F.col("text"), F.col("pii.spans")).alias("clean")).collect()
    found = [r for r in out if r.text and "token" in r.text]
    assert sum(r.clean == 'api token = "[KEY]" ok' for r in found) > 140
    assert not any(r.spans for r in out if r.text and r.text.startswith("see "))
    assert [r.clean for r in out[-3:]] == ["mail [EMAIL] now, [EMAIL]", None, ""]


def test_overlaps_are_cut_once(spark):
    df = spark.createDataFrame([("0123456789", [(2, 0, 6), (4, 1, 8), (8, 3, 9)])], "text string, s array<struct<start:int,rank:int,end:int>>")
    row = df.select(pii.redacted(F.col("text"), F.col("s")).alias("t")).first()
    assert row.t == "01[EMAIL][PHONE]9"


def test_least_scores():
    rows = [("key", 0.9, True)] * 12 + [("key", 0.5, True), ("key", 0.5, False), ("mail", 0.9, True)]
    assert pii.least_scores(rows, 0.95) == {"key": 0.9}


def test_learns_from_all_candidates(spark):
    """Among 20,000 other candidates, 60 tokens are enough to learn from."""
    rng = random.Random(2)
    token = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    rows = [(f'api token = "{token()}" ok',) for _ in range(60)] + [(f"see /path/{i % 9}/long-name-of-some-file-{i} ok",) for i in range(20_000)]
    df = spark.createDataFrame(rows, "text string").repartition(8)
    model = pii.fit(df, F.col("text"))
    out = pii.with_spans(df, F.col("text"), model).select("text", F.size("pii.spans").alias("n")).collect()
    assert len(out) == len(rows)
    assert all(row.n == ("token" in row.text) for row in out)


def test_split_points(spark):
    rng = random.Random(3)
    rows = [([float(rng.randrange(2)), float(rng.randrange(32) * 3), float(int(rng.gauss(0, 40))), 7.0], rng.randrange(1, 4)) for _ in range(3000)]
    cuts = pii.split_points(spark.createDataFrame(rows, "x array<double>, n long").repartition(3))
    assert cuts[0] == [0.5] and cuts[1] == [3 * i + 1.5 for i in range(31)] and cuts[3] == []
    values = sorted(x[2] for x, n in rows for _ in range(n))
    parts = [sum(a < v <= b for v in values) for a, b in zip([-1e9, *cuts[2]], [*cuts[2], 1e9])]
    assert len(parts) == pii.BINS and max(parts) < 2 * len(values) / pii.BINS
    df = spark.createDataFrame(rows, "x array<double>, n long").select("x", pii.binned(F.col("x"), cuts).alias("b"))
    assert all(row.b == [sum(v > c for c in own) for v, own in zip(row.x, cuts)] for row in df.collect())


def test_trees_over_split_points(spark):
    """The columns score as the trees of the library do over binned features."""
    rng = random.Random(4)
    rows = [([float(rng.randrange(100)), float(rng.randrange(3))],) for _ in range(400)]
    df = spark.createDataFrame(rows, "x array<double>").withColumn("label", (F.col("x")[0] * F.col("x")[1] > 60).cast("double"))
    cuts = pii.split_points(df.withColumn("n", F.lit(1)))
    binned = df.withColumn("features", pii.array_to_vector(pii.binned(F.col("x"), cuts)))
    fitted = pii.GBTClassifier(maxIter=3, maxDepth=3, maxBins=pii.BINS, seed=1).fit(binned)
    trees = [(w, t._call_java("rootNode")) for w, t in zip(fitted.treeWeights, fitted.trees)]
    scored = fitted.transform(binned).withColumn("own", pii.Model(trees, {}, cuts).score_of(F.col("x")))
    for row in scored.collect():
        assert abs(row.probability[1] - row.own) < 1e-9
