"""Personal data by weak supervision. DataFrame functions only on the data's path.

Fixed patterns give the base spans. Further candidates (credentials, national telephone
numbers) are voted on by labelers: shape patterns, a gazetteer of key words, and context.
Expectation-maximisation over the counts of vote patterns, of which there are a few
hundred whatever the corpus, estimates how reliable each labeler is; the resulting soft
labels train a logistic span classifier on the counts of feature patterns. The classifier
is then an expression over the spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.arrays import let, running_offsets
from tarn.session import durable

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "telephone")

# The fixed patterns. A start that is not at the beginning of a run of its characters
# cannot match where the run's beginning did not, so it is not tried: long runs stay linear.
# Java walks a repeated group by recursion unless it is possessive; no other one is unbounded.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
# On text in which only separators between two digits are left.
CARD = r"[0-9][0-9 -]*[0-9]"
LOOSE_SEPARATOR = r"(?<![0-9])[ -]|[ -](?![0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+"
TELEPHONE = r"(?<![0-9(+-])(?:\([0-9]{3}\) |[0-9]{3}[ -])[0-9]{3}[ -][0-9]{4}(?![0-9-])"

#: Words before a span that speak for it, as fixed values: English, French, German, Spanish.
GAZETTEER = (
    "password", "passwd", "token", "secret", "key", "auth", "phone", "tel", "call", "mobile", "fax",
    "mot de passe", "jeton", "clé", "téléphone", "portable", "appelez",
    "passwort", "kennwort", "geheimnis", "schlüssel", "telefon", "handy", "anruf",
    "contraseña", "clave", "secreto", "teléfono", "móvil", "llame",
)
CONTEXT = 24

SPAN = "array<struct<start:int,stop:int,kind:int,found:string>>"
#: What the classifier sees of a span besides the votes.
TRAITS = ("long", "hexadecimal", "varied", "ends_in_digit", "telephone")
VOTES = ("shape", "gazetteer", "assigned", "mixture", "surroundings")
ROUNDS = 50


def _located(text: Column, guard: Column, pattern: str, kind: int) -> Column:
    """Every match of ``pattern`` with its code point positions."""

    def found(x: Column) -> Column:
        return F.struct(
            F.regexp_extract_all(x, F.lit(pattern), F.lit(0)).alias("found"),
            F.split(x, pattern, -1).alias("gaps"),
        )

    def place(m: Column) -> Column:
        steps = F.zip_with(m["gaps"], m["found"], lambda g, f: F.length(g) + F.coalesce(F.length(f), F.lit(0)))
        spans = F.zip_with(
            F.slice(running_offsets(steps), F.lit(2), F.size(m["found"])),
            m["found"],
            lambda e, f: F.struct(
                (e - F.length(f)).cast("int").alias("start"),
                e.cast("int").alias("stop"),
                F.lit(kind).alias("kind"),
                f.alias("found"),
            ),
        )
        return F.when(F.size(m["found"]) > 0, spans).otherwise(F.array().cast(SPAN))

    return F.when(guard, let(let(text, found), place)).otherwise(F.array().cast(SPAN))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, doubling every second one from the right, add up to a multiple of ten."""
    each = F.split(F.reverse(digits), "")

    def add(total: Column, x: Column) -> Column:
        return total + x

    doubled = F.transform(
        F.filter(each, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), add) % 10 == 0


def _valid_ip(found: Column) -> Column:
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """Spans of the four fixed kinds, by start and then kind."""
    email = _located(text, F.contains(text, F.lit("@")), EMAIL, 0)
    ip = _located(text, F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), IP, 1)
    plain = F.regexp_replace(text, LOOSE_SEPARATOR, "_")
    long_number = F.rlike(text, F.lit(r"[0-9](?:[ -]?[0-9]){11}"))
    card = _located(F.when(long_number, plain), long_number, CARD, 2)
    phone = _located(text, F.contains(text, F.lit("+")) & F.rlike(text, F.lit(r"\+[0-9]")), PHONE, 3)
    card = F.filter(
        card,
        lambda s: let(_digits(s["found"]), lambda d: F.length(d).between(12, 19) & _luhn(F.substring(d, 1, 20))),
    )
    kept = F.concat(
        email,
        F.filter(ip, lambda s: _valid_ip(s["found"])),
        card,
        F.filter(phone, lambda s: F.length(_digits(s["found"])).between(9, 15)),
    )
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"], s["kind"], s["stop"])))


def candidate_spans(text: Column, base: Column) -> Column:
    """Further spans with the labelers' votes: 1 for personal data, -1 against, 0 no opinion."""
    has_digit = F.rlike(text, F.lit("[0-9]"))
    secret = _located(text, has_digit & F.rlike(text, F.lit("[A-Za-z0-9]{16}")), SECRET, 4)
    phone = _located(text, has_digit & F.rlike(text, F.lit(r"[0-9][) -]{1,2}[0-9]{3}[ -][0-9]{4}")), TELEPHONE, 5)
    spans = F.filter(
        F.concat(secret, phone),
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"])),
    )
    words = "|".join(GAZETTEER)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")

    def voted(s: Column) -> Column:
        x = s["found"]
        before = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
        changes = F.length(F.regexp_replace(F.regexp_replace(x, "[0-9]+", "0"), "[A-Za-z]+", "a"))
        is_phone = s["kind"] == 5
        shape = vote(
            is_phone | F.rlike(x, F.lit("^(?:[0-9a-f]{16,}+|[A-Z0-9]{20})$")), F.rlike(x, F.lit("^[A-Za-z]+[0-9]+$"))
        )
        known = vote(F.rlike(before, F.lit(rf"(?iU)\b(?:{words})\b[^\pL\pN]*+$")), F.lit(False))
        assigned = vote(F.rlike(before, F.lit("[=:]\\s*[\"']?$")), F.rlike(before, F.lit("[/#@]$")))
        mixture = vote(changes >= 5, ~is_phone & (changes <= 2))
        after = F.substring(text, s["stop"] + 1, F.lit(1))
        alone = F.rlike(before, F.lit("(?:^|[\\s\"'=:(])$")) & F.rlike(after, F.lit("^(?:[\\s\"',.;:)]|$)"))
        return F.struct(
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            s["kind"].alias("kind"),
            F.array(shape, known, assigned, mixture, vote(alone, ~alone)).alias("votes"),
            F.array(
                *[
                    F.when(trait, 1).otherwise(0).cast("tinyint")
                    for trait in (
                        F.length(x) >= 32,
                        F.rlike(x, F.lit("^[0-9A-Fa-f]++$")),
                        F.size(F.array_distinct(F.split(F.substring(x, 1, 256), ""))) >= 12,
                        F.rlike(x, F.lit("[0-9]$")),
                        is_phone,
                    )
                ]
            ).alias("traits"),
        )

    return F.transform(spans, voted)


def reliabilities(counts: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """Prior and, for each labeler, (chance of a vote for given personal data, the same given
    none), by expectation-maximisation over (votes, count)."""
    prior = 0.5
    # A vote for counts as more likely on personal data to begin with.
    rates = [(0.8, 0.3)] * len(VOTES)
    total = sum(n for _, n in counts)
    for _ in range(ROUNDS if total else 0):
        soft = [(v, n, posterior(v, prior, rates)) for v, n in counts]
        mass = sum(n * p for _, n, p in soft)
        prior = min(max((mass + 1) / (total + 2), 0.01), 0.99)
        rates = []
        for k in range(len(VOTES)):
            says = [(v[k], n, p) for v, n, p in soft if v[k]]
            # Two imagined votes for each side keep every rate away from 0 and 1.
            yes = (sum(n * p for s, n, p in says if s > 0) + 1.6) / (sum(n * p for _, n, p in says) + 2)
            no = (sum(n * (1 - p) for s, n, p in says if s > 0) + 0.6) / (sum(n * (1 - p) for _, n, p in says) + 2)
            rates.append((yes, no))
    return prior, rates


def posterior(votes: tuple[int, ...], prior: float, rates: list[tuple[float, float]]) -> float:
    odds = math.log(prior / (1 - prior))
    for v, (yes, no) in zip(votes, rates, strict=True):
        if v > 0:
            odds += math.log(yes / no)
        elif v < 0:
            odds += math.log((1 - yes) / (1 - no))
    return 1 / (1 + math.exp(-max(min(odds, 30), -30)))


def train(counts: list[tuple[tuple[int, ...], tuple[int, ...], int]], steps: int = 400) -> list[float]:
    """Weights of a logistic classifier on votes and traits, fitted to the soft labels of the
    votes. The traits let it tell apart spans on which the votes agree.

    ``counts`` holds (votes, traits, count) of every pattern: at most 3**5 * 2**5 of them.
    """
    merged: dict[tuple[int, ...], int] = {}
    for v, _, n in counts:
        merged[v] = merged.get(v, 0) + n
    prior, rates = reliabilities(sorted(merged.items()))
    total = sum(merged.values())
    rows = [((1.0, *map(float, v), *map(float, t)), n / total, posterior(v, prior, rates)) for v, t, n in counts]
    weights = [0.0] * (1 + len(VOTES) + len(TRAITS))
    for _ in range(steps if rows else 0):
        slope = [0.001 * w for w in weights]
        for x, n, p in rows:
            miss = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x, strict=True)))) - p
            for i, b in enumerate(x):
                slope[i] += n * miss * b
        weights = [w - 1.0 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def find_private(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with base and spans, arrays of (start, kind, stop).

    ``base`` holds the fixed kinds (0 email, 1 ip, 2 card, 3 phone), ``spans`` these and
    the candidates the classifier accepts (4 secret, 5 telephone). Positions are code
    points, the end exclusive. A null or empty text has none. Repeated rows are each
    answered. Columns of ``docs`` named base or spans are replaced.

    The labelers learn from all rows; only counts of vote patterns reach the driver.
    """
    docs = docs.drop("base", "spans")
    text = F.coalesce("text", F.lit(""))
    found = docs.withColumn("base", base_spans(text))
    found = found.withColumn("_candidates", candidate_spans(text, F.col("base")))
    found = durable(found)
    patterns = found.where(F.size("_candidates") > 0).select(F.explode("_candidates").alias("c"))
    counts = patterns.groupBy("c.votes", "c.traits").count().collect()
    weights = train(sorted((tuple(r["votes"]), tuple(r["traits"]), r["count"]) for r in counts))

    def accepted(c: Column) -> Column:
        score = F.lit(weights[0])
        for k, w in enumerate(weights[1:]):
            seen = c["votes"][k] if k < len(VOTES) else c["traits"][k - len(VOTES)]
            score = score + seen * F.lit(w)
        return score > 0

    added = F.transform(
        F.filter("_candidates", accepted), lambda c: F.struct(c["start"], c["kind"], c["stop"])
    )
    return found.withColumn("spans", F.array_sort(F.concat("base", added))).drop("_candidates")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *EXTRA_KINDS)])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the
    characters of all are replaced, by the kind of the first."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, *EXTRA_KINDS)])
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        mark = F.when(s["start"] >= done["at"], F.get(marks, s["kind"])).otherwise("")
        return F.struct(
            F.greatest(done["at"], s["stop"]).alias("at"),
            F.concat(done["parts"], F.array(gap, mark)).alias("parts"),
        )

    whole = F.aggregate(
        spans,
        none,
        step,
        lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(text, d["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)
