"""Secret scans by character Markov models, in DataFrame functions only.

Two first-order models of characters, one of random strings and one of ordinary identifiers and words, are trained
from labelled strings: some drawn from the alphabets in which secrets are written, the public names of library
modules, and the short words of all documents. A token of 12 characters or more is a secret, besides the
matches of the three base patterns, if its log-likelihood ratio outweighs how rare secrets are.
"""

from __future__ import annotations

import importlib
import math
import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.native import SPAN, apart_from, let, named, shown, spans

#: The base patterns; repeats of a fixed least length match the same spans as longer-or-dropped runs do.
ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]{8,}+$"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex")
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings drawn as labelled examples of the random class; no input is left out by this number.
SAMPLES = 4000
#: Letters, and only these, between characters that no token holds: the words that are examples of the ordinary class too.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,11}(?![A-Za-z0-9+/_=-])"
#: Parts of a text, in which no token is cut; only one part's words are held at a time.
PART = r"(?s).{1,65536}+[A-Za-z0-9+/_=-]*+"
#: Modules whose public names are examples of ordinary identifiers.
MODULES = (
    "argparse ast asyncio base64 calendar codecs collections concurrent.futures configparser contextlib csv ctypes dataclasses datetime decimal difflib dis "
    "email.message errno fractions functools glob gzip hashlib heapq html http.client importlib inspect io ipaddress itertools json locale logging "
    "mimetypes multiprocessing numbers operator os pathlib pickle platform plistlib queue random re sched selectors shutil signal socket sqlite3 ssl stat "
    "statistics string struct subprocess sys tarfile tempfile textwrap threading time tokenize traceback types typing unicodedata unittest urllib.parse "
    "uuid warnings weakref xml.dom.minidom zipfile"
).split()
#: One token in so many is a secret before its characters are looked at; the ratio must outweigh that.
RARITY = 1e6


def random_strings(seed: int = 11) -> list[str]:
    """Strings drawn evenly from the alphabets of keys, tokens and digests."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[:26] + "234567", "0123456789ABCDEF", ALPHABET[:52], ALPHABET[26:62])
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 64))) for i in range(SAMPLES)]


def identifiers(modules: Iterable[str] = MODULES) -> list[str]:
    """Public names of modules and of their classes, and joined as in paths and constants."""
    out: set[str] = set()
    for name in modules:
        module = importlib.import_module(name)
        out.add(name.replace(".", "/"))
        for x in sorted(vars(module)):
            out |= {x, f"{name.replace('.', '-')}_{x}", x.upper()}
            if isinstance(own := vars(module)[x], type):
                out |= {y for y in vars(own) if isinstance(y, str)}
    return sorted(x for x in out if len(x) > 1 and set(x) <= set(ALPHABET))


def pairs_of(strings: Iterable[str]) -> dict[str, float]:
    """How often each pair of characters follows one another."""
    out: dict[str, float] = {}
    for s in strings:
        for k in range(len(s) - 1):
            out[s[k : k + 2]] = out.get(s[k : k + 2], 0) + 1
    return out


def word_pairs(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Pairs of letters in the short words of all documents, whole texts; at most 52 ** 2 counts are kept by a task and reach the driver.

    Words of 4 to 11 letters are never asked about themselves, so secrets in the documents do not teach that they are ordinary.
    """
    parts = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(PART), F.lit(0))).alias("t"))
    words = parts.select(F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("w"))
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("pair"))
    return {r["pair"]: float(r["count"]) for r in each.groupBy("pair").count().collect()}


def ratios(words: dict[str, float], smoothing: float = 0.5) -> list[float]:
    """log P(random) - log P(ordinary) of each pair of characters, as a flat square table.

    ``words``: pairs in ordinary words; they weigh as much as the identifiers, and a tenth of that in capitals.
    """
    n = len(ALPHABET)

    def model(*samples: tuple[dict[str, float], float]) -> list[list[float]]:
        counts = [[smoothing] * n for _ in range(n)]
        for pairs, weight in samples:
            for pair, count in pairs.items():
                counts[ALPHABET.index(pair[0])][ALPHABET.index(pair[1])] += count * weight
        return [[math.log(x / sum(row)) for x in row] for row in counts]

    known = pairs_of(identifiers())
    weight = sum(known.values()) / max(1.0, sum(words.values()))
    capitals: dict[str, float] = {}
    for pair, count in words.items():
        capitals[pair.upper()] = capitals.get(pair.upper(), 0) + count
    secret, ordinary = model((pairs_of(random_strings()), 1.0)), model((known, 1.0), (words, weight), (capitals, weight / 10))
    return [x - y for rx, ry in zip(secret, ordinary, strict=True) for x, y in zip(rx, ry, strict=True)]


def likelihood_ratio(token: Column, table: list[float]) -> Column:
    """The models' log-likelihood ratio, summed over the token's character steps; the token is cut into characters once."""
    n = len(ALPHABET)
    steps = F.array(*(F.lit(round(x, 4)) for x in table))
    places = F.array(*(F.lit(max(0, ALPHABET.find(chr(c)))) for c in range(128)))

    def summed(at: Column) -> Column:
        each = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.get(steps, a * n + b))
        return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)

    return let(F.transform(F.split(token, ""), lambda c: F.get(places, F.ascii(c))), summed)


def secrets(docs: DataFrame, rarity: float = RARITY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row; no shuffle of texts.

    A token of 12 characters or more with a letter counts as random if its summed log-likelihood ratio is
    over log(rarity) and it overlaps no base span. Spans are ordered by start, then kind. A null text counts as
    empty; texts and tokens of any length cost in proportion to it; of tied spans the kinds' order decides;
    repeated rows give a row each; an empty table gives no rows; other columns are ignored.
    """
    table = ratios(word_pairs(docs))
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    base = {
        "assign": F.filter(spans(text, ASSIGN), lambda s: F.regexp_replace(s["value"], r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?", "").rlike("^" + ASSIGN_VALUE)),
        "access": spans(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": spans(text, HEX),
    }
    rows = rows.withColumns({**{f"n_{k}": c for k, c in base.items()}, "tokens": spans(text, TOKEN)})
    rows = rows.withColumn("base", F.concat(*(named(F.col(f"n_{k}"), k) for k in KINDS)))

    def odd(s: Column) -> Column:
        return s["value"].rlike("[A-Za-z]") & (likelihood_ratio(s["value"], table) > math.log(rarity))

    # the models are asked first: few tokens are left to compare with base spans
    rows = rows.withColumn("odd", F.when(F.size("tokens") > 0, F.filter("tokens", odd)).otherwise(F.array().cast(SPAN)))
    rows = rows.withColumn("random", named(apart_from(F.col("odd"), F.col("base")), "random"))
    ranks = {k: i for i, k in enumerate((*KINDS, "random"))}

    def by_start(found: Column) -> Column:
        def rank(kind: Column) -> Column:
            out = F.lit(len(ranks))
            for k, i in ranks.items():
                out = F.when(kind == k, i).otherwise(out)
            return out

        keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return rows.select(
        "doc_id", *(F.size(f"n_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(shown(by_start(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        shown(by_start(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
