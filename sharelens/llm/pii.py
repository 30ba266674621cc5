"""Personal data: base detectors, and spans that boosted trees add from high-recall candidates.

All DataFrame functions; texts are read once. Base spans come from the fixed patterns and their checks.
Generators propose further, overlapping candidates: number-like runs and spelled-out addresses. A
candidate's format and context are binned; positive examples are those whose text passes a check once its
signs are normalised, and the bins do not show what that check asks for. Boosting runs over the counts of the distinct bin combinations, of which
there are at most a few thousand whatever the corpus; its trees are then ordinary column
expressions. Thresholds are calibrated on candidates of a fold that was not trained on, and only on those that may be added (no base
span covers them, or they extend one of their kind): groups of equal scores are pooled with their neighbours until a higher
score never has the smaller share of positives, and a score is good enough where its pool, and all candidates from it upwards,
are positive in at least ``PRECISION`` of cases. What is added passes the check of its kind as well. Folds go by the
candidate's text and counts enter as shares, so a text is treated alike in a corpus and in many copies of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharelens.llm.common import packed, text_of, unpacked
from sharelens.session import collect_bounded, scratch_path, settle

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, equal to the contract's leftmost non-overlapping matches but linear on long runs: possessive
#: repeats, and a start that is no continuation of a run (or stands where the last match ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain before its pattern is worth trying.
MARKS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Candidate generators: number-like runs, and addresses with spelled-out or spaced signs.
NUMBER_LIKE = r"(?<![0-9A-Za-z])[(]?[0-9][\x20().0-9-]{6,}[0-9](?![0-9A-Za-z])"
AT, DOT = (rf"\x20?[(\x5B](?i:{sign})[)\x5D]\x20?" for sign in ("at", "dot"))
LABELS = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?@\x20?|{AT})[A-Za-z0-9-]++"
ADDRESS_LIKE = rf"{LABELS}(?:(?:\x20?\.\x20?|{DOT})[A-Za-z0-9-]++)++"
#: The same without points that may end a sentence; may overlap the others.
ADDRESS_CLOSE = rf"{LABELS}(?:(?:\.|\x20\.\x20|{DOT})[A-Za-z0-9-]++)++"
#: Last labels of addresses: generic and reserved ones; two lower-case letters are a country's.
LAST_LABEL = (
    "(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|jobs|mobi|travel|app|dev|blog|shop|site|online|tech|cloud|email|xyz|"
    "example|test|invalid|local|[a-z]{2})"
)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PRECISION, ROUNDS, RATE, FOLDS, TOTAL = 0.95, 20, 0.3, 5, 10_000
SPAN = "array<struct<start:int,end:int,kind:int,found:string>>"


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits; ``digits`` holds digits only."""
    places = F.sequence(F.lit(1), F.char_length(digits))

    def worth(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        double = F.when(i % 2 == 0, digit * 2).otherwise(digit)
        return F.when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda t, x: t + x) % 10 == 0


def accepted(kind: str, found: Column) -> Column:
    """The base check of a match."""
    length = F.char_length(digits_of(found))
    if kind == "ip":
        return found.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    if kind == "card":
        return length.between(12, 19) & luhn(digits_of(found))
    return length.between(9, 15) if kind == "phone" else F.lit(True)


def matches(text: Column, pattern: str, kind: int, worth: Column) -> Column:
    """All matches of a pattern as spans in code points. Offsets add up the pieces between matches."""
    none = F.array().cast(SPAN)
    found = F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    spans = F.aggregate(
        F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda f, g: F.struct(f.alias("f"), g.alias("g"))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda t, x: F.struct(
            (t["at"] + x["g"] + F.char_length(x["f"])).alias("at"),
            F.concat(
                t["out"],
                F.array(
                    F.struct(
                        (t["at"] + x["g"]).alias("start"),
                        (t["at"] + x["g"] + F.char_length(x["f"])).alias("end"),
                        F.lit(kind).alias("kind"),
                        x["f"].alias("found"),
                    )
                ),
            ).cast(SPAN).alias("out"),
        ),
        lambda t: t["out"],
    )
    return F.when(F.size(found) > 0, spans).otherwise(none)


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` spans and ``numbers`` and ``addresses``, the candidates; one pass over the texts."""
    text = text_of()
    out = docs
    for number, kind in enumerate(KINDS):
        worth = text.contains(MARKS[kind]) if MARKS[kind] else text.rlike("[0-9][0-9\\x20-]{10}")
        out = out.withColumn(f"_{kind}", matches(text, PATTERNS[kind], number, worth))
    passing = lambda kind: lambda s: accepted(kind, s["found"])
    checked = [F.filter(f"_{kind}", passing(kind)) for kind in KINDS]
    return (
        out.withColumn("base", F.array_sort(F.concat(*checked)))
        .withColumn("_numbers", matches(text, NUMBER_LIKE, 0, text.rlike("[0-9][\\x20().0-9-]{6}")))
        .withColumn("_addresses", F.array_distinct(F.concat(*(matches(text, p, 0, text.rlike("@|[(\\x5B](?i:at)[)\\x5D]")) for p in (ADDRESS_LIKE, ADDRESS_CLOSE)))))
        .withColumn("numbers", with_context("_numbers", text))
        .withColumn("addresses", with_context("_addresses", text))
        .drop(*(f"_{kind}" for kind in KINDS), "_numbers", "_addresses")
    )


def with_context(spans: str, text: Column) -> Column:
    """Candidates with the character before them and the last word before that."""
    before = lambda s: F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["found"].alias("found"),
            F.substring(before(s), -1, 1).alias("prior"),
            F.lower(F.regexp_extract(before(s), r"([A-Za-z]+)[^A-Za-z0-9]*$", 1)).alias("word"),
        ),
    )


#: Features of a candidate: bins of its format and context. Few values each, so their combinations are bounded.
def number_bins(s: Column) -> list[Column]:
    n = F.char_length(digits_of(s["found"]))
    groups = F.size(F.split(s["found"], "[^0-9]+"))
    return [
        F.when(n < 9, 0).when(n < 10, 1).when(n == 10, 2).when(n == 11, 3).when(n == 12, 4).when(n < 16, 5).when(n == 16, 6).when(n < 20, 7).otherwise(8),
        F.least(groups, F.lit(6)),
        s["found"].rlike(r"[()]").cast("int"),
        s["found"].rlike(r"\.").cast("int"),
        s["found"].rlike("-").cast("int"),
        s["found"].rlike(r"\x20").cast("int"),
        F.when(s["prior"].isin("", " ", "\n", "\t"), 0).when(s["prior"] == "+", 0).when(s["prior"].isin(":", "=", "#"), 1).otherwise(2),
        F.when(s["word"].isin("tel", "phone", "call", "fax", "mobile"), 1).when(s["word"].isin("card", "visa", "credit", "account"), 2).when(s["word"].isin("ip", "host", "server", "address"), 3).otherwise(0),
    ]


def address_bins(s: Column) -> list[Column]:
    found = s["found"]
    return [
        F.when(found.rlike(AT), 3).when(found.contains(" @ "), 2).when(found.rlike(r"\x20@|@\x20"), 1).otherwise(0),
        F.when(found.rlike(r"[^\x20]\.\x20|\x20\.[^\x20]"), 1).when(found.rlike(DOT), 3).when(found.contains(" . "), 2).otherwise(0),
        F.least(F.size(F.split(plain_address(found), r"\.")), F.lit(4)),
        found.rlike("[0-9]").cast("int"),
        F.when(s["word"].isin("mail", "email", "contact", "write"), 1).otherwise(0),
    ]


def plain_address(found: Column) -> Column:
    """An address with its signs as they are in plain ones."""
    signs = F.regexp_replace(F.regexp_replace(found, AT, "@"), DOT, ".")
    return F.regexp_replace(signs, r"\x20?([@.])\x20?", "$1")


def is_ip(s: Column) -> Column:
    return accepted("ip", F.regexp_replace(s["found"], r"[\x20()]*\.[\x20()]*", "."))


def is_card(s: Column) -> Column:
    return accepted("card", s["found"])


def is_phone(s: Column) -> Column:
    return (s["prior"] == "+") & accepted("phone", s["found"])


def is_email(s: Column) -> Column:
    return plain_address(s["found"]).rlike(rf"^[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+{LAST_LABEL}$")


#: kind -> where its candidates are, their bins, and what makes one a positive example
LEARNED: dict[str, tuple[str, Callable, Callable]] = {
    "email": ("addresses", address_bins, is_email),
    "ip": ("numbers", number_bins, is_ip),
    "card": ("numbers", number_bins, is_card),
    "phone": ("numbers", number_bins, is_phone),
}
#: Upper bound on the distinct bin combinations of one kind, and so on what training collects.
MAX_CELLS = 9 * 6 * 2**4 * 3 * 4


def may_be_added(s: Column, number: int) -> Column:
    """Whether a candidate overlaps no base span but those of its kind that it extends."""
    longer = lambda b: (s["start"] <= b["start"]) & (b["end"] <= s["end"]) & (b["end"] - b["start"] < s["end"] - s["start"])
    return ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]) & ~((b["kind"] == number) & longer(b)))


def cells(detected: DataFrame, kind: str) -> list[tuple[tuple[int, ...], float, float, float, float]]:
    """Counts per bin combination: (bins, trained positives, trained, calibration positives, calibration).

    Calibration counts candidates that may be added, of the held-out fold.
    """
    where, bins, positive = LEARNED[kind]
    number = KINDS.index(kind)
    each = detected.select(F.explode(F.transform(where, lambda s: F.struct(s.alias("s"), may_be_added(s, number).alias("free")))).alias("x")).select("x.s", "x.free")
    held, good = F.pmod(F.xxhash64("s.found"), F.lit(FOLDS)) == 0, positive(F.col("s"))
    count = lambda cond: F.sum(cond.cast("double"))
    grouped = each.groupBy(F.array(*bins(F.col("s"))).alias("bins")).agg(
        count(~held & good).alias("p"), count(~held).alias("n"), count(held & good & F.col("free")).alias("cp"), count(held & F.col("free")).alias("cn")
    )
    return sorted((tuple(r["bins"]), r["p"], r["n"], r["cp"], r["cn"]) for r in collect_bounded(grouped, MAX_CELLS, "candidate bins"))


class Boosted:
    """Gradient-boosted two-level trees over binned candidates, fitted to counts, with a calibrated threshold."""

    def __init__(self, rows: list, rounds: int = ROUNDS, rate: float = RATE, precision: float = PRECISION):
        # shares of a fixed total, so the trees do not depend on how often a corpus repeats itself
        scale = TOTAL / max(1.0, sum(r[2] for r in rows))
        rows = [(bins, p * scale, n * scale, good, held) for bins, p, n, good, held in rows]
        total, good = sum(r[2] for r in rows), sum(r[1] for r in rows)
        share = (good + 1) / (total + 2)
        self.start = math.log(share / (1 - share))
        self.trees: list[tuple[int, int, tuple, tuple]] = []
        self.threshold: float | None = None
        scores = [self.start] * len(rows)
        if not good:
            return
        values = sorted({(f, v) for r in rows for f, v in enumerate(r[0])})
        for _ in range(rounds):
            chance = [1 / (1 + math.exp(-s)) for s in scores]
            slope = [r[1] - r[2] * c for r, c in zip(rows, chance, strict=True)]
            curve = [r[2] * c * (1 - c) for r, c in zip(rows, chance, strict=True)]
            best = self._split(rows, range(len(rows)), slope, curve, values)
            if best is None:
                break
            f, v = best
            sides = [[i for i, r in enumerate(rows) if (r[0][f] == v) is yes] for yes in (True, False)]
            branches = []
            for side in sides:
                inner = self._split(rows, side, slope, curve, values)
                if inner is None:
                    branches.append((None, None, self._leaf(side, slope, curve, rate), 0.0))
                else:
                    g, w = inner
                    yes, no = [i for i in side if rows[i][0][g] == w], [i for i in side if rows[i][0][g] != w]
                    branches.append((g, w, self._leaf(yes, slope, curve, rate), self._leaf(no, slope, curve, rate)))
            self.trees.append((f, v, *branches))
            scores = [self.score(r[0]) for r in rows]
        self._calibrate(rows, precision)

    @staticmethod
    def _leaf(side, slope, curve, rate):
        return rate * sum(slope[i] for i in side) / (sum(curve[i] for i in side) + 1.0)

    @staticmethod
    def _split(rows, side, slope, curve, values):
        gain = lambda g, h: g * g / (h + 1.0)
        g_all, h_all = sum(slope[i] for i in side), sum(curve[i] for i in side)
        best, found = 1e-9, None
        for f, v in values:
            g = sum(slope[i] for i in side if rows[i][0][f] == v)
            h = sum(curve[i] for i in side if rows[i][0][f] == v)
            won = gain(g, h) + gain(g_all - g, h_all - h) - gain(g_all, h_all)
            if won > best + 1e-12:
                best, found = won, (f, v)
        return found

    def _calibrate(self, rows, precision):
        """The lowest score of the pools of held-out candidates that are positive often enough."""
        by_score: dict[float, list[float]] = {}
        for bins, _, _, good, n in rows:
            sums = by_score.setdefault(round(self.score(bins), 6), [0.0, 0.0])
            sums[0] += good
            sums[1] += n
        pools: list[tuple[float, float, float]] = []
        for score in sorted(by_score, reverse=True):
            good, n = by_score[score]
            if not n:
                continue
            while pools and good * pools[-1][2] > pools[-1][1] * n:
                _, more, others = pools.pop()
                good, n = good + more, n + others
            pools.append((score, good, n))
        good = n = 0.0
        for score, more, others in pools:
            if more < precision * others:
                break
            good, n = good + more, n + others
            if good >= precision * n:
                self.threshold = score - 1e-6

    def score(self, bins) -> float:
        total = self.start
        for f, v, yes, no in self.trees:
            g, w, a, b = yes if bins[f] == v else no
            total += a if g is None or bins[g] == w else b
        return total

    def column(self, bins: list[Column]) -> Column:
        """The score as an expression."""
        branch = lambda b: F.lit(b[2]) if b[0] is None else F.when(bins[b[0]] == b[1], b[2]).otherwise(b[3])
        total = F.lit(self.start)
        for f, v, yes, no in self.trees:
            total = total + F.when(bins[f] == v, branch(yes)).otherwise(branch(no))
        return total


def learn(detected: DataFrame) -> dict[str, Boosted]:
    """One boosted model per kind, from the counts of the whole corpus."""
    return {kind: Boosted(cells(detected, kind)) for kind in KINDS}


def chosen(kind: str, number: int, model: Boosted) -> Column:
    """The candidates of a kind that may be added, pass its check and score high enough, as spans."""
    where, bins, positive = LEARNED[kind]
    size = len(bins(F.struct(F.lit("").alias("found"), F.lit("").alias("prior"), F.lit("").alias("word"))))
    free = lambda s: may_be_added(s, number) & positive(s)
    scored = F.transform(where, lambda s: F.struct(s.alias("s"), F.array(*bins(s)).alias("b")))
    high = lambda x: model.column([F.get(x["b"], F.lit(i)) for i in range(size)]) >= model.threshold
    span = lambda x: F.struct(
        x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), F.lit(number).alias("kind"), x["s"]["found"].alias("found")
    )
    return F.transform(F.filter(scored, lambda x: free(x["s"]) & high(x)), span).cast(SPAN)


def add_spans(detected: DataFrame, models: dict[str, Boosted]) -> DataFrame:
    """Adds ``spans``: the base spans and those candidates of each kind that ``chosen`` takes."""
    extra = [F.col("base").cast(SPAN)]
    for number, kind in enumerate(KINDS):
        if models[kind].threshold is not None:
            extra.append(chosen(kind, number, models[kind]))
    ordered = F.array_sort(
        F.transform(F.concat(*extra), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    )
    return detected.withColumn("spans", F.array_distinct(ordered))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and kind."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base (spans by start, kind), spans (with those the trees add).

    Spans are (start, end, kind) in code points, end exclusive. Null and empty texts have none. Repeated
    rows get equal spans. Without a positive example among the candidates that may be added a kind adds
    nothing. An empty table gives an empty result. Other columns are ignored.
    """
    detected = settle(detect(docs.select("doc_id", "text")).drop("text"))
    return add_spans(detected, learn(detected))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, same columns; overlapping spans become one.

    Null and empty texts stay as they are. ``n_chars``, if there is such a column, follows a changed text.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "pii")
    detect(packed(docs, "doc_id", "text")).write.parquet(path)
    stored = spark.read.parquet(path)
    marked = add_spans(stored, learn(stored)).withColumnRenamed("text", "whole")
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    source = F.col("whole")
    built = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda t, s: F.struct(
            F.when(s["start"] >= t["at"], F.concat(t["out"], F.substring(source, t["at"] + 1, s["start"] - t["at"]), F.get(labels, s["kind"])))
            .otherwise(t["out"])
            .alias("out"),
            F.greatest(t["at"], s["end"]).alias("at"),
        ),
        lambda t: F.concat(t["out"], F.substring(source, t["at"] + 1, F.char_length(source))),
    )
    hit = F.size("spans") > 0
    changed = {
        "text": lambda old: F.when(hit, built).otherwise(old),
        "n_chars": lambda old: F.when(hit, F.char_length(built).cast("bigint")).otherwise(old),
    }
    return unpacked(marked, docs.columns, changed)
