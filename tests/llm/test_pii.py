"""Base detectors against Python's patterns; boosting and redaction."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sharelens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(kind, m.group())]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


HARD = [
    "a@b.c_d@e.f", "a@b@c.d", "x@y", "a.b@c.d.e.", "%+-@-.-", "é@b.c", "😀 me@x.org 😀 1.2.3.4",
    "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.01.1.1", "1.2.3", "1.2.3.4.5", "999999999999999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "41111111111111111111", "4111  1111 1111 1111", "0 0000000000000", "000000000000",
    "+44 20 7946 0958", "+1 (017) 555-7713.", "+1", "++12 345 678 90", "+1 2 +345678901 (2)", "+123456789012345678", "+1 (843) 555-7672 170.106.47.218",
    None, "", "1" * 5000, "a" * 20000, "1 " * 3000, "@" * 3000, "a@b." * 500,
]


def test_hard_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    found = {r.doc_id: r.s for r in pii.detect(docs).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()}
    assert found == {i: brute(t) for i, t in enumerate(HARD)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="01259 .@+-()aé_\n", max_size=60), min_size=40, max_size=40))
def test_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.s for r in pii.detect(docs).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}


def test_boosting_separates_and_calibrates():
    rows = [((a, b), 90.0 if a and b else 1.0, 100.0, 400.0 if a and b else 0.0, 401.0) for a in (0, 1) for b in (0, 1)]
    model = pii.Boosted(rows)
    high, low = model.score((1, 1)), max(model.score((0, 1)), model.score((1, 0)), model.score((0, 0)))
    assert high > 0 > low and low < model.threshold <= high
    assert pii.Boosted([((0,), 0.0, 10.0, 0.0, 5.0)]).threshold is None
    assert pii.Boosted([((0,), 3.0, 3.0, 0.0, 0.0)]).threshold is None  # nothing to calibrate on
    small, large = (pii.Boosted([(b, p * k, n * k, cp * k, cn * k) for b, p, n, cp, cn in rows]) for k in (1, 1000))
    assert abs(small.threshold - large.threshold) < 1e-6


def test_spelled_out_addresses_are_learned(spark):
    docs = [(i, f"please mail me: person{i}@site.example.org today") for i in range(600)]
    docs.append((1000, "please mail me: someone @ site.example.org today"))
    found = pii.find_pii(spark.createDataFrame(docs, "doc_id bigint, text string"))
    base = {r.doc_id: r.n for r in found.select("doc_id", F.size("base").alias("n")).collect()}
    assert base[5] == 1 and base[1000] == 0


def test_redaction(spark):
    text = "😀 write a@b.org or call +44 20 7946 0958, card 4111 1111 1111 1111."
    docs = spark.createDataFrame([(1, text, len(text)), (2, "nothing", 7), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    rows = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    want = "😀 write [EMAIL] or call [PHONE], card [CARD]."
    assert rows == {1: (want, len(want)), 2: ("nothing", 7), 3: (None, None)}


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a@b.org")], "doc_id bigint, text string")
    plan = pii.detect(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_spelled_out_addresses_are_in_spans(spark):
    signs = ["person{} [at] site [dot] org", "person{} @ site.org", "person{}@site.org", "person{} (AT) mail.site (dot) org"]
    docs = [(i, f"please mail me: {signs[i % 4].format(i)} today. Lunch @ cafe. Then we go") for i in range(1200)]
    found = pii.find_pii(spark.createDataFrame(docs, "doc_id bigint, text string"))
    rows = {r.doc_id: r.s for r in found.select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert rows == {i: f"email:16:{16 + len(signs[i % 4].format(i))}" for i in range(1200)}


def test_dotted_cards_and_spaced_ips_are_learned(spark):
    cards = [f"41111111{i:07d}" for i in range(600)]
    cards = [c + next(d for d in "0123456789" if luhn(c + d)) for c in cards]
    texts = [f"card {'.'.join(c[k : k + 4] for k in (0, 4, 8, 12))} ok" for c in cards] + [f"ip 10 . 1 . {i % 256} . 7 ok" for i in range(600)]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    rows = {r.doc_id: r.s for r in found.select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert rows == {i: f"card:5:{len(t) - 3}" if i < 600 else f"ip:3:{len(t) - 3}" for i, t in enumerate(texts)}


def test_a_small_group_does_not_end_the_calibration():
    def threshold(*groups):
        model = object.__new__(pii.Boosted)
        model.start, model.trees, model.threshold = 0.0, [], None
        model.score = lambda bins: float(bins[0])
        model._calibrate([((score,), 0.0, 0.0, float(good), float(n)) for score, good, n in groups], 0.95)
        return model.threshold and round(model.threshold)

    many = (2, 990_000, 1_000_000)
    assert threshold((3, 4, 4), many, (1, 10, 1_000)) == 2
    assert threshold((3, 1, 2), many, (1, 10, 1_000)) == 2
    assert threshold((3, 12, 12), (2, 5, 10)) == threshold((3, 12_000, 12_000), (2, 5_000, 10_000)) == 3
    assert threshold((3, 990_000, 1_000_000), (2, 10, 1_000)) == 3


PLAIN = [f"{5_731_080_387_000_000 + 977 * i}" for i in range(800)]


def plain_and_cards():
    plain = [p for p in PLAIN if not luhn(p)][:500]
    stems = [f"41111111{i:07d}" for i in range(50)]
    cards = [c + next(d for d in "0123456789" if luhn(c + d)) for c in stems]
    return [f"number {p} here" for p in plain], [f"card {c} ok" for c in cards]


def test_plain_numbers_are_no_cards_at_any_size(spark):
    plain, cards = plain_and_cards()
    for texts in (plain[:6] + cards[:4], plain[:70] + cards[:30], plain + cards, (plain + cards) * 18):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        found = pii.find_pii(docs).where(F.size("spans") > F.size("base"))
        assert found.count() == 0


def test_a_corpus_and_its_copies_are_treated_alike(spark):
    plain, cards = plain_and_cards()
    dotted = [f"card {'.'.join(c[5 + k : 9 + k] for k in (0, 4, 8, 12))} ok" for c in cards]
    spelled = [f"mail person{i} [at] site [dot] org" for i in range(40)]
    corpus = plain[:40] + cards[:10] + dotted[:20] + spelled
    results = []
    for copies in (1, 10, 100):
        docs = spark.createDataFrame([(i + 1000 * k, t) for k in range(copies) for i, t in enumerate(corpus)], "doc_id bigint, text string")
        found = pii.find_pii(docs).select((F.col("doc_id") % 1000).alias("i"), pii.listed(F.col("spans")).alias("s")).distinct().collect()
        results.append(sorted(tuple(r) for r in found))
    assert len(results[0]) == len(corpus) and results[0] == results[1] == results[2]
    assert sum("email" in s for _, s in results[0]) == 40
