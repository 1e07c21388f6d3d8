"""Personal data by weak supervision, in DataFrame functions only.

Four strict patterns find the base spans. Looser candidates (handles, groups of figures, names, addresses,
codes) are voted on by labelers: formats, word lists (gazetteers) and context cues, each for, against or silent.
Expectation-maximisation over the counts of vote patterns, kind by kind, estimates the labelers' reliabilities, and its
posteriors train the final span classifier, a logistic model over kinds, shapes and votes. The base spans need no
vote and take no part in the fit. Vote patterns and shapes are few by construction (see CODES), so the driver fits
on counts.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import written
from heddle.llm.native import apart_from, blocks_of, cut, digits, first_of_overlapping, let, luhn, named, reached, shown, spans

#: The base patterns. Possessive repeats and the look-behinds keep searches linear and match the same spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")

#: Looser candidates. Bounded repeats and look-behinds keep every search in proportion to the text.
LOOSE = {
    "handle": r"(?<![^\s(\[,;:])[^\s@(\[,;:]*+@[^\s@,;)\]]++",
    "number": r"(?<![0-9][\x20().-]{0,2})(?<![0-9A-Za-z.,/+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}+(?![0-9A-Za-z])",
    "address": r"(?<![0-9A-Za-z.,/-])[0-9]{1,5}+(?:\x20[A-Z][a-z]++){2,4}+",
    "name": r"(?<![A-Za-z0-9])(?!(?:Dear|Dr|From|Hello|Hi|Mr|Mrs|Ms|Prof|To|With)\x20)[A-Z][a-z]++(?:\x20(?:[A-Z]\.\x20)?+[A-Z][a-z]++){1,2}+(?![A-Za-z0-9])",
    "code": r"(?<![A-Za-z0-9])[A-Z]{1,2}+[0-9]{2}(?:\x20?+[0-9A-Z]){4,30}+(?![A-Za-z0-9])",
}
EXTRA = tuple(LOOSE)
#: A cheap necessary condition of a kind's candidates.
PRESENT = {"handle": "@"}
CONTEXT = 32

#: Word lists, in natural order.
MAIL_WORDS = ("com", "edu", "gmail", "hotmail", "mail", "net", "org", "outlook", "proton", "yahoo")
GIVEN = (
    "Ahmed", "Alice", "Ana", "Andrew", "Anna", "Anne", "Anthony", "Antonio", "Barbara", "Carlos", "Carol", "Charles", "Chen", "Claire", "Daniel", "David", "Elena", "Elizabeth", "Emily", "Emma",
    "Fatima", "Francisco", "George", "Hans", "Helen", "Ivan", "James", "Jane", "Javier", "Jennifer", "Johannes", "John", "Jose", "Joseph", "Julia", "Karen", "Laura", "Linda", "Louis", "Luis",
    "Maria", "Marie", "Mark", "Martin", "Mary", "Michael", "Mohammed", "Nancy", "Nicolas", "Olivia", "Patricia", "Paul", "Peter", "Pierre", "Richard", "Robert", "Sandra", "Sarah", "Sofia",
    "Sophie", "Stefan", "Susan", "Thomas", "Wei", "William",
)
STREETS = ("Allee", "Avenue", "Ave", "Boulevard", "Calle", "Court", "Drive", "Lane", "Platz", "Road", "Rue", "Square", "Strasse", "Street", "Way")
COUNTRIES = ("AT", "BE", "CH", "DE", "ES", "FR", "GB", "IE", "IT", "LU", "NL", "PL", "PT", "SE")
#: Words that capitalised pairs hold when they are no person's name.
COMMON = (
    "After", "And", "April", "At", "August", "Bank", "But", "By", "Central", "City", "College", "Company", "Council", "Court", "December", "Department", "East", "February", "For", "From",
    "Great", "He", "House", "I", "In", "Institute", "International", "It", "January", "July", "June", "Lake", "March", "May", "Monday", "Mount", "National", "New", "North", "November",
    "October", "Of", "On", "Park", "Press", "Republic", "River", "Road", "Royal", "San", "Saturday", "School", "September", "She", "South", "State", "States", "Street", "Sunday",
    "The", "They", "This", "Thursday", "Tuesday", "Union", "United", "University", "War", "We", "Wednesday", "West", "When", "World", "You",
)
CUES = (
    "account", "address", "birth", "call", "called", "cell", "contact", "dear", "dr", "email", "e-mail", "fax", "follow", "handle", "iban", "id", "lives at", "mail", "mobile", "mr", "mrs", "ms", "name",
    "named", "number", "passport", "patient", "phone", "prof", "resident", "sincerely", "signed", "ssn", "tel", "telephone", "whatsapp",
)
COUNTS = ("chapter", "eur", "figure", "isbn", "items", "model", "page", "pages", "part", "price", "section", "serial", "total", "usd", "version", "year", "years")

#: Labelers in order: each is for, against or silent on a candidate (kind, value, before, after).
LABELERS = ("format", "gazetteer", "cue_before", "cue_after", "count_context", "plain")
#: Reliabilities that estimation starts from and falls back to: P(against, silent, for) of other candidates and of personal data.
PRIOR = ((0.25, 0.70, 0.05), (0.05, 0.60, 0.35))
#: Candidates that the starting reliabilities count for, besides a hundredth of a kind's candidates.
PRIOR_WEIGHT = 20.0
SHAPES = ("grouped", "long", "nine_digits", "ten_to_eleven", "check_digit")
#: Codes that may reach the driver: kinds * 3 ** labelers * 2 ** shapes.
CODES = len(EXTRA) * 3 ** len(LABELERS) * 2 ** len(SHAPES)


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> its base spans; a match that fails its test is dropped, nothing else is tried in its place."""

    def few(value: Column, least: int, most: int) -> Column:
        return F.length(digits(value)).between(least, most)

    return {
        "email": spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, IP), lambda s: s["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": F.filter(spans(text, CARD), lambda s: few(s["value"], 13, 19) & luhn(s["value"])),
        "phone": F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda s: few(s["value"], 9, 15)),
    }


def _any(value: Column, words: tuple[str, ...]) -> Column:
    return value.rlike(rf"(?i)(?<![a-z])(?:{'|'.join(words)})(?![a-z])")


def _word(value: Column, words: tuple[str, ...]) -> Column:
    return value.rlike(rf"(?<![A-Za-z])(?:{'|'.join(words)})(?![A-Za-z])")


def iban(value: Column) -> Column:
    """Whether a code's check digits fit: four characters moved to the end, letters as 10 to 35, remainder 1 by 97."""
    plain = F.regexp_replace(value, " ", "")
    figures = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a >= 65, (rest * 100 + a - 55) % 97).otherwise((rest * 10 + a - 48) % 97)

    return plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.aggregate(figures, F.lit(0), step) == 1)


def _votes(kind: str, c: Column) -> list[Column]:
    def vote(yes: Column | None = None, no: Column | None = None) -> Column:
        out = F.lit(0)
        if no is not None:
            out = F.when(no, -1).otherwise(out)
        return out if yes is None else F.when(yes, 1).otherwise(out)

    value, before, after = c["value"], c["before"], c["after"]
    figures = F.length(digits(value))
    grouped = value.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^\(?0[0-9]{2,4}\)?[ -][0-9]{5,8}$")
    formats = {
        "handle": vote(value.rlike(r"^@[A-Za-z][A-Za-z0-9_.]{2,}$|^[A-Za-z0-9_.+-]+@[A-Za-z0-9_]{2,}"), value.rlike(r"^@$|@[^A-Za-z]|^@[A-Za-z]{1,2}$")),
        "number": vote(grouped, (figures < 9) | (figures > 15)),
        "address": vote(_word(value, STREETS)),
        "name": vote(value.rlike(r" [A-Z]\. ")),
        "code": vote(iban(value) | value.rlike("^[A-Z]{1,2}[0-9]{6,9}$"), value.rlike("[A-Z]{4}")),
    }
    lists = {
        "handle": vote(_any(value, MAIL_WORDS)),
        "number": vote(),
        "address": vote(_word(value, STREETS), _word(value, ("April", "August", "December", "February", "January", "July", "June", "March", "May", "November", "October", "September"))),
        "name": vote(value.rlike(rf"^(?:{'|'.join(GIVEN)}) "), _word(value, COMMON)),
        "code": vote(value.rlike(rf"^(?:{'|'.join(COUNTRIES)})[0-9]")),
    }
    plain = {
        "handle": vote(),
        "number": vote(None, ~value.rlike("[ ().-]")),
        "address": vote(None, ~_word(value, STREETS)),
        "name": vote(None, before.rlike(r"(?:^|[.!?:|>*#\n])[\s\"']*$") & ~_any(before, CUES)),
        "code": vote(),
    }
    said = r"^,? (?:said|says|wrote|was born|lives|lived|can be reached)|^'s (?:phone|address|email|number)|^ \((?:age|aged|born)"
    return [
        formats[kind], lists[kind], vote(before.rlike(rf"(?i)(?<![a-z])(?:{'|'.join(CUES)})(?![a-z])[^.!?\n]{{0,12}}$")), vote(after.rlike(said), after.rlike(r"^\s?(?:%|[A-Za-z]{0,2}\$|€|(?:kg|km|items|pages|units)\b)")),
        vote(None, before.rlike(rf"(?i)(?<![a-z])(?:{'|'.join(COUNTS)})(?![a-z])[^.!?\n]{{0,12}}$")), plain[kind],
    ]


def _shapes(kind: str, c: Column) -> list[Column]:
    value, n = c["value"], F.length(digits(c["value"]))
    return [value.rlike(r"[0-9][ ().-]+[0-9]"), F.length(value) > 16, n == 9, n.between(10, 11), (n >= 13) & luhn(value) if kind == "number" else F.lit(False)]


def _candidates(kind: str, found: Column) -> Column:
    """start, end, kind and one code of each candidate: kind, votes and shapes as the digits of a number."""

    def one(c: Column) -> Column:
        code = F.lit(EXTRA.index(kind))
        for v in _votes(kind, c):
            code = code * 3 + v + 1
        for s in _shapes(kind, c):
            code = code * 2 + F.when(s, 1).otherwise(0)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(kind).alias("kind"), code.cast("int").alias("code"))

    return F.transform(found, one)


def evidence(docs: DataFrame, row: Column, text: Column) -> DataFrame:
    """row, base (kind, start, end: by kind, then start) and loose (start, end, kind, code: those apart from base, by start) of every row."""
    rows = docs.select(row.alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    t = F.col("text")
    rows = rows.withColumns({f"b_{k}": c for k, c in base_spans(t).items()})
    rows = rows.withColumn("base", F.concat(*(named(F.col(f"b_{k}"), k) for k in KINDS)))
    rows = rows.withColumns({f"l_{k}": spans(t, p, F.contains(t, F.lit(PRESENT[k])) if k in PRESENT else None, CONTEXT) for k, p in LOOSE.items()})
    rows = rows.withColumns({f"l_{k}": apart_from(F.col(f"l_{k}"), F.col("base")) for k in EXTRA})
    return rows.withColumn("loose", F.sort_array(F.concat(*(_candidates(k, F.col(f"l_{k}")) for k in EXTRA)))).drop(*(f"b_{k}" for k in KINDS), *(f"l_{k}" for k in EXTRA))


def decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, votes (n x labelers: 0 against, 1 silent, 2 for) and shapes (n x shapes) of codes."""
    bits = [codes >> k & 1 for k in range(len(SHAPES) - 1, -1, -1)]
    rest = codes >> len(SHAPES)
    votes = [rest // 3**k % 3 for k in range(len(LABELERS) - 1, -1, -1)]
    return rest // 3 ** len(LABELERS), np.stack(votes, axis=1), np.stack(bits, axis=1)


@dataclass(frozen=True)
class Model:
    """Each kind's share of personal data and reliabilities (class x labeler x vote), and the classifier's weights."""

    shares: dict[str, float]
    reliability: dict[str, list]
    bias: float
    weights: tuple[float, ...]


def features(codes: np.ndarray) -> np.ndarray:
    """Kind (one of), votes (-1, 0, 1) and shapes as numbers."""
    kind, votes, shapes = decoded(codes)
    return np.concatenate([kind[:, None] == np.arange(len(EXTRA)), votes - 1, shapes], axis=1).astype(float)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of personal data, reliabilities and the vote patterns' posteriors, labelers taken as independent given the class.

    The starting reliabilities stay as pseudo-counts, so that a kind without any personal data is not split in two classes.
    """
    weight = PRIOR_WEIGHT + 0.01 * counts.sum()
    start = np.repeat(np.array(PRIOR)[:, None, :], votes.shape[1], axis=1)
    table, share, posterior = start.copy(), 0.1, np.zeros(len(counts))
    hot = votes[:, :, None] == np.arange(3)
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + (hot * np.log(table[1] / table[0])).sum(axis=(1, 2))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        share = (0.1 * PRIOR_WEIGHT + (counts * posterior).sum()) / (PRIOR_WEIGHT + counts.sum())
        for label, p in enumerate((1 - posterior, posterior)):
            sums = weight * start[label] + ((counts * p)[:, None, None] * hot).sum(axis=0)
            table[label] = sums / sums.sum(axis=1, keepdims=True)
    return float(share), table, posterior


def few_votes() -> np.ndarray:
    """The codes of each kind, without shapes, on which three labelers at most speak."""
    n = len(LABELERS)
    some = [v for v in itertools.product((0, 1, 2), repeat=n) if sum(x != 1 for x in v) <= 3]
    return np.array([(k * 3**n + sum(x * 3 ** (n - 1 - i) for i, x in enumerate(v))) << len(SHAPES) for k in range(len(EXTRA)) for v in some])


def fit(counted: list[tuple[int, int]], steps: int = 400, rate: float = 2.0, decay: float = 0.0005) -> Model:
    """A model of (code, count) rows. Patterns of few votes count as seen once, so that rare ones get their due."""
    rare = few_votes()
    codes, counts = (np.array(c, dtype=np.int64) for c in zip(*sorted(counted), strict=True)) if counted else np.empty((2, 0), dtype=np.int64)
    seen = len(codes)
    codes, counts = np.r_[codes, rare], np.r_[counts, np.ones(len(rare), dtype=np.int64)]
    kind, votes, _ = decoded(codes)
    target, shares, reliability = np.zeros(len(codes)), {}, {}
    for k, name in enumerate(EXTRA):
        own = kind == k
        real = np.where(np.arange(len(codes)) < seen, counts, 0)[own].astype(float)
        shares[name], table, target[own] = expectation_maximisation(votes[own], real)
        reliability[name] = table.tolist()
    x, weights, bias = features(codes), np.zeros(len(EXTRA) + len(LABELERS) + len(SHAPES)), -1.0
    # a pattern weighs as the root of its count: a frequent one must not drown the rare ones that tell the classes apart
    weight = np.sqrt(counts)
    weight = weight / weight.sum()
    for _ in range(steps):
        miss = weight * (1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - target)
        weights = weights - rate * (x.T @ miss + decay * weights)
        bias = bias - rate * miss.sum()
    return Model(shares, reliability, float(bias), tuple(weights.tolist()))


def fit_on(found: DataFrame) -> Model:
    """Fit on the candidates of all rows: at most CODES counts reach the driver."""
    rows = found.select(F.explode("loose.code").alias("code")).groupBy("code").count().collect()
    return fit([(r["code"], r["count"]) for r in rows])


def accepted(loose: Column, model: Model) -> Column:
    """The candidates that the classifier takes for personal data and for which a labeler speaks; of overlapping ones the first."""

    def score(code: Column) -> Column:
        z, at = F.lit(model.bias), len(EXTRA)
        rest = F.shiftright(code, len(SHAPES))
        for k in range(len(SHAPES)):
            z = z + model.weights[-1 - k] * F.shiftright(code, k).bitwiseAND(F.lit(1))
        for k in range(len(LABELERS)):
            z = z + model.weights[at + len(LABELERS) - 1 - k] * (F.floor(rest / 3**k) % 3 - 1)
        kind = F.floor(rest / 3 ** len(LABELERS))
        for k in range(len(EXTRA)):
            z = z + F.when(kind == k, model.weights[k]).otherwise(0.0)
        return z

    def backed(code: Column) -> Column:
        rest = F.shiftright(code, len(SHAPES))
        out = F.lit(False)
        for k in range(len(LABELERS)):
            out = out | (F.floor(rest / 3**k) % 3 == 2)
        return out

    return let(F.filter(loose, lambda c: backed(c["code"]) & (score(c["code"]) > 0)), first_of_overlapping)


def _spans(found: Column) -> Column:
    """kind, start, end of accepted candidates, by kind, then start."""
    return F.concat(*(named(F.filter(found, _is_kind(k)), k) for k in EXTRA))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other of every row.

    The text is read once: spans and coded candidates go to a table in the shared folder, on whose
    counts the model is fitted and from which the result comes. Added spans follow the base ones, by kind (see
    LOOSE), then start; n_other counts them. A null text counts as empty; texts without spans have the digest of
    the empty string and spans ''; texts of any length, and with any number of spans, cost in proportion to
    it; of overlapping candidates the first is taken, ties by end; repeated rows give a row each; an empty table gives no
    rows; other columns are ignored.
    """
    found = written(evidence(docs, F.col("doc_id"), F.col("text")).drop("text"), "personal")
    model = fit_on(found)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rows = found.withColumn("other", _spans(accepted(F.col("loose"), model)))
    return rows.select(
        F.col("row").alias("doc_id"), *(count(k) for k in KINDS), F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        shown(F.concat("base", "other")).alias("spans"), F.size("other").cast("long").alias("n_other"),
    )


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, each span in the text replaced by its kind in angle brackets.

    Rows go to a table once, with their evidence, on whose counts the model is fitted. Overlapping spans become one,
    named by the first (at one place, the longest). Null and empty texts stay as they are; texts of any length cost in proportion to it;
    repeated rows come back each; an empty table gives no rows; other columns, whatever their names, are kept.
    """
    columns = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in columns))
    rows = written(evidence(docs, whole, F.col(f"`{text_col}`")).drop("text"), "personal")
    model = fit_on(rows)
    text = F.col(f"row.`{text_col}`")

    def masked(found: Column) -> Column:
        def clear(xs: Column) -> Column:  # of spans within others nothing is left to replace
            return let(reached(F.transform(xs, lambda x: x["end"])), lambda behind: F.filter(F.transform(xs, lambda x, i: opened(x, F.get(behind, i))), lambda x: x["end"] > x["start"]))

        def opened(x: Column, behind: Column) -> Column:
            return F.struct(F.greatest(x["start"], behind).alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), (x["start"] < behind).alias("joined"))

        def piece(xs: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                begin = F.when(i > 0, F.get(xs, i - 1)["end"]).otherwise(0)
                return F.concat(cut(F.col("blocks"), begin, x["start"]), F.when(x["joined"], F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))))

            return F.concat(F.array_join(F.transform(xs, one), ""), cut(F.col("blocks"), F.element_at(xs, -1)["end"], F.length(text)))

        by_place = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
        by_place = F.transform(by_place, lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind")))
        return let(let(by_place, clear), piece)

    rows = rows.withColumn("all", F.concat("base", _spans(accepted(F.col("loose"), model))))
    rows = rows.withColumn("blocks", F.when(F.size("all") > 0, blocks_of(text)).otherwise(F.array().cast("array<string>")))
    clean = F.when(F.size("all") > 0, masked(F.col("all"))).otherwise(text)
    return rows.withColumn("clean", clean).select(*(F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns))
