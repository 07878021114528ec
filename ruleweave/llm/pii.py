"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Base spans come from four patterns. Besides, every token with a digit or an @ may be
an identifier. The seeds are the base spans and the tokens that look like a random
key (:func:`secret`). A lexical pattern is the two words, or the word and the mark
of assignment, before a token. Spark scores the graph of patterns and instances in
rounds: a pattern's confidence is the mean trust of its instances, an instance is
trusted by the patterns that hold it (noisy or over those of confidence above a
half), seeds fully. Instances that become trusted count as seeds of further patterns
in the next round. Patterns of high confidence and enough trusted instances turn
every token that they precede into a span of the kind ``id``, whatever it looks like.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, saved

KINDS = ("email", "ip", "card", "phone")
EXTRA = "id"
ROUNDS = 4
#: A trusted pattern has at least this confidence and so many different trusted instances.
CONFIDENCE = 0.9
LEAST_SEEDS = 5
#: Confidence from which a pattern passes trust on, and trust from which an instance counts as a seed.
PASSES = 0.5
TRUSTED = 0.9
#: A run of letters and digits of at least so many characters, with so many changes between letters and digits, looks like a random key.
KEY_RUN = 16
KEY_CHANGES = 4

# Fixed patterns. Runs of digits and of what stands between them hold all matches but those of email.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9+][0-9+\x20().-]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")
#: What tokens end at, besides white space; marks of assignment are words of a context.
_ENDS = frozenset("\"'`()<>[]{}|,;=:")
_ASSIGNS = frozenset("=:")
_KEY = re.compile(r"[A-Za-z0-9]{%d,}" % KEY_RUN)
_CHANGE = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is all of its characters before an @, back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind, in code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    for run in _RUN.finditer(text):
        start, end = run.span()
        if end - start < 7:
            continue
        for m in _IP.finditer(text, start, end):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m.group().split("."))):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text, start, end):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        for m in _PHONE.finditer(text, start, end):
            if 8 <= len(_DIGITS.findall(m.group())) <= 15:
                out["phone"].append(m.span())
    return out


def secret(token: str) -> bool:
    """Whether a token holds a long run of letters and digits in turns, as random keys do."""
    return any(len(_CHANGE.findall(run)) >= KEY_CHANGES for run in _KEY.findall(token))


def _inside(c: str) -> bool:
    return not c.isspace() and c not in _ENDS


def _words_before(text: str, at: int, count: int = 2) -> str:
    """The words and marks of assignment before a place, in lower case, digits as 0; ``^`` stands for the start of the text."""
    words: list[str] = []
    while len(words) < count:
        while at and not _inside(text[at - 1]) and text[at - 1] not in _ASSIGNS:
            at -= 1
        if not at:
            words.append("^")
            continue
        end = at
        if text[at - 1] in _ASSIGNS:
            at -= 1
        else:
            while at and _inside(text[at - 1]):
                at -= 1
        words.append(_DIGITS.sub("0", text[at:end].lower()))
    pattern = " ".join(reversed(words))
    # a long pattern goes by its hash
    return pattern if len(pattern) <= 80 else "#" + hashlib.blake2b(pattern.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def instances(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, str, int, int, bool, bool]]:
    """(pattern, instance, start, end, is a seed, is a base span): the base spans, and other tokens with a digit or an @."""
    taken = sorted((s, e) for spans in base.values() for s, e in spans)
    out = [(_words_before(text, s), text[s:e].lower(), s, e, True, True) for s, e in taken]
    done = k = 0
    for run in re.finditer(r"[0-9]+|@", text):
        if run.start() < done:
            continue
        start, end = run.start(), run.end()
        while start > done and _inside(text[start - 1]):
            start -= 1
        while end < len(text) and _inside(text[end]):
            end += 1
        done = end
        end -= len(text[start:end]) - len(text[start:end].rstrip(".!?"))
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end <= start or k < len(taken) and taken[k][0] < end:  # base spans stay as they are
            continue
        token = text[start:end]
        if token != "@":
            out.append((_words_before(text, start), token.lower(), start, end, secret(token), False))
    return out


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, held array<struct<pattern:string,instance:long,start:int,`end`:int,seed:boolean,base:boolean>>"
_HELD = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("base", pa.bool_())]))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, spans, held = {k: [] for k in KINDS}, [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            for k in KINDS:
                counts[k].append(len(base[k]))
            spans.append(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k]))
            key = lambda x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            held.append([(p, key(i), *rest) for p, i, *rest in instances(text, base)])
        columns = [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(spans, pa.string()), pa.array(held, _HELD)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_spans", "held"])


def trusted_patterns(held: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = LEAST_SEEDS) -> DataFrame:
    """Patterns (pattern, confidence) to trust, from occurrences (pattern, instance, seed).

    All patterns stay in the graph: one without a seed can be trusted for the
    instances that others made trusted.
    """
    edges = saved(held.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    trust = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("trust"))
    patterns = edges
    for _ in range(rounds):
        # seeds are counted anew in each round: what was found since counts
        patterns = edges.join(trust, "instance").groupBy("pattern").agg(F.avg("trust").alias("confidence"), F.count(F.when(F.col("trust") >= TRUSTED, 1)).alias("seeds"))
        patterns = saved(patterns.where((F.col("seeds") >= seeds) & (F.col("confidence") >= PASSES)), "patterns")
        doubt = F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))
        scored = edges.join(patterns, "pattern").groupBy("instance").agg((1 - doubt).alias("score"))
        seen = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
        trust = seen.join(scored, "instance", "left").select("instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("trust"))
        trust = saved(trust, "trust")
    return patterns.where(F.col("confidence") >= confidence).select("pattern", "confidence")


def personal_data(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = LEAST_SEEDS) -> DataFrame:
    """One row a document: doc_id, the numbers of base spans, base_sha256, spans, n_id and n_spans.

    ``spans`` joins kind:start:end of the base spans, by kind and start, and then of
    the spans of kind ``id`` that trusted contexts add; those never overlap base
    spans. ``n_spans`` counts both. A null text is an empty one, whose spans are the empty string. Repeated
    rows and null ids are searched each. An empty table gives an empty result;
    other columns are not read.
    """
    python_ready(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_searched, _FOUND)
    found = saved(found.withColumn("row", F.monotonically_increasing_id()), "found")
    held = found.select("row", F.explode("held").alias("x")).select("row", "x.*")
    trusted = trusted_patterns(held.select("pattern", "instance", "seed"), rounds, confidence, seeds)
    added = held.where("not base").join(trusted, "pattern", "left_semi")
    added = added.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("added"))
    added = saved(added, "added")
    out = found.drop("held").join(added, "row", "left")
    more = F.transform("added", lambda x: F.concat_ws(":", F.lit(EXTRA), x["start"].cast("string"), x["end"].cast("string")))
    spans = F.concat_ws(",", F.nullif("base_spans", F.lit("")), F.nullif(F.array_join(more, ","), F.lit("")))
    n_id = F.coalesce(F.size("added"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), spans.alias("spans"), n_id.alias("n_id"), (sum((F.col(f"n_{k}") for k in KINDS), n_id)).alias("n_spans"),
    )
