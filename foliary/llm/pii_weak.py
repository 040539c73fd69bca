"""Personal data by weak supervision.

Spans of a strict format are found by fixed rules and always stay. Looser candidates, and the strict ones with them,
are put before labelers that vote yes, no or nothing: formats, gazetteers and context. Expectation-maximisation over
the counts of vote patterns of the whole corpus estimates how reliable each labeler is (Dawid and Skene, 1979), and its
posteriors train a logistic classifier on features of the span: its shape, what the labelers saw and, which they don't,
the word before it as a hashed bucket. The classifier decides on the looser candidates.

Texts are read once. Votes and features are small codes, so what reaches the driver are counts of code pairs: at most
KINDS x 72 x 2^FEATURES rows (72 vote patterns can occur), some thousands in practice, whatever the corpus holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Workspace

#: Kinds in the order of their listing; the first four have fixed rules.
KINDS = ["email", "ip", "card", "phone", "name", "id", "secret"]
EMAIL, IP, CARD, PHONE, NAME, ID, SECRET = range(7)
LABELERS = ["strict", "format", "gazetteer", "context", "border"]
#: Bits of a span's features: BITS of yes and no, and those of the bucket of the word before it.
BITS, BUCKET_BITS = 8, 4
FEATURES = BITS + BUCKET_BITS
#: The classifier's probability from which a loose candidate is a span.
ACCEPT = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The expressions below match what the plain ones match; possessive parts and the look-behind keep them linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP_RULE = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
LAST_WORD = re.compile(r"([^\W\d_]+)[\W\d_]*\Z")
CARD_RULE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RULE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY_DIGIT, ANY_LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

LOOSE_EMAIL = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[(\[{](?:at|AT)[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?[(\[{](?:dot|DOT)[)\]}] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}")
#: Words or numbers with dashes, as in the addresses of pages.
DASHED = re.compile(r"[a-z]+(?:[-_/=+][a-z0-9]*)+|[0-9]+(?:[-_/=+][0-9]*)*")
LOOSE_PHONE = re.compile(r"(?<![0-9+.])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
LOOSE_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}[ ./_\xa0-][0-9]{4}[ ./_\xa0-][0-9]{4}[ ./_\xa0-][0-9]{1,7}(?![0-9])")
LOOSE_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+|-----BEGIN [A-Z ]*PRIVATE KEY-----")
LOOSE_NAME = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}){1,2}")

#: Frequent given names of the four languages.
GIVEN_NAMES = frozenset(
    "Alexander Alice Andreas Anna Antonio Barbara Carlos Carmen Catherine Charles Charlotte Christian Claire Daniel David "
    "Elizabeth Emily Emma Felix Francisco Françoise Frank Friedrich George Hans Heinrich Helen Henri Isabel Jack Jacques James "
    "Javier Jean Jennifer Jessica John José Joseph Juan Julia Jürgen Karen Karl Klaus Laura Linda Louis Lucía Luis Manuel "
    "Margaret Maria María Marie Mark Martin Mary Matthew Michael Michel Miguel Monique Nancy Nicolas Patricia Paul Pedro Peter "
    "Philippe Pierre Rafael Richard Robert Rosa Sabine Sandra Sarah Sophie Stefan Stephen Susan Thomas Ursula William Wolfgang".split()
)
#: Ends of host names that are frequent.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu ch at us ca mx".split())
#: First digits of the large card schemes.
CARD_HEADS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
#: How the keys of widely used services begin, as they publish it.
KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "AIza", "eyJ", "-----BEGIN")
CUES = {
    EMAIL: re.compile(r"e-?mail|contact|write to|correo|courriel|kontakt", re.I),
    IP: re.compile(r"\bip\b|address|server|host|login|adresse|dirección", re.I),
    CARD: re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.I),
    PHONE: re.compile(r"phone|\btel|call|mobile|fax|anruf|appel|llam", re.I),
    NAME: re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Mlle|Sra?|Señora?)\.? $|(?:my name is|signed,?|ich heiße|je m'appelle|me llamo) $"),
    SECRET: re.compile(r"(?:password|passwd|pwd|secret|token|api[ _-]?key|access[ _-]?key|bearer|credential)s?\W{0,6}$", re.I),
    ID: re.compile(r"\bssn\b|social|iban|account|passport|\bid\b|konto|compte|cuenta", re.I),
}
NO_CUES = re.compile(r"version|release|isbn|section|figure|chapter|order no|license|licence|article|serial", re.I)
SECRET_NO_CUES = re.compile(r"sha-?[0-9]*|md5|checksum|digest|commit|hash|etag|uuid|https?:|www\.", re.I)
NAME_NO_CUES = re.compile(r"(?:[.!?|:]|^)[\s\"']*$")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def strict_emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        else:
            end = max(end, start)
        at = text.find("@", max(at + 1, end))


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def digit_spans(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, is it by the rule) of matches of the rules that hold digits."""
    for m in IP_RULE.finditer(text):
        yield IP, m.start(), m.end(), is_ip(m[0])
    for m in CARD_RULE.finditer(text):
        digits = digits_of(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield CARD, m.start(), m.end(), True
    for m in PHONE_RULE.finditer(text):
        n = len(digits_of(m[0]))
        if 7 <= n <= 17:
            yield PHONE, m.start(), m.end(), 9 <= n <= 15


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, strict): all strict spans, and loose ones that don't touch them, in order."""
    found = [(EMAIL, s, e, True) for s, e in strict_emails(text)] if "@" in text else []
    loose = []
    if ANY_DIGIT.search(text):
        spans = list(digit_spans(text))
        found += [x for x in spans if x[3]]
        loose += [x for x in spans if not x[3]]
        loose += [(PHONE, m.start(), m.end(), False) for m in LOOSE_PHONE.finditer(text)]
        loose += [(CARD, m.start(), m.end(), False) for m in LOOSE_CARD.finditer(text) if luhn(digits_of(m[0]))]
        loose += [(SECRET, m.start(), m.end(), False) for m in LOOSE_SECRET.finditer(text) if ANY_DIGIT.search(m[0]) and ANY_LETTER.search(m[0]) or m[0][:5] == "-----"]
        loose += [(ID, m.start(), m.end(), False) for m in LOOSE_ID.finditer(text)]
    if "(" in text or "[" in text or "{" in text:
        loose += [(EMAIL, m.start(), m.end(), False) for m in LOOSE_EMAIL.finditer(text)]
    loose += [(NAME, m.start(), m.end(), False) for m in LOOSE_NAME.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    starts = np.array([s for s, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    for x in sorted(set(loose)):
        before = int(np.searchsorted(starts, x[2])) - 1
        if before < 0 or reach[before] <= x[1]:
            found.append(x)
    return sorted(found)


def bits_a_character(span: str) -> float:
    """Entropy of the characters, which is low for words and repeated ones."""
    n = np.array(list(Counter(span).values())) / len(span)
    return float(-(n * np.log2(n)).sum())


def votes_of(text: str, kind: int, start: int, end: int, strict: bool) -> list[int]:
    """1 yes, 0 no, 2 nothing, by labeler."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = digits_of(span)
    form = gaze = 2
    if kind == EMAIL:
        form = int(3 <= len(span) <= 254 and ".." not in span)
        gaze = int(re.split(r"[^A-Za-z]+", span.rstrip(")]}"))[-1].lower() in TOP_DOMAINS)
    elif kind == IP:
        form = int(all(p == "0" or p[0] != "0" for p in span.split(".")))
        gaze = 0 if span.split(".")[0] in ("0", "127", "255") else 2
    elif kind == CARD:
        form = int(len(set(digits)) > 2 and len({len(p) for p in re.split(r"[ -]", span)}) <= 2)
        gaze = int(digits.startswith(CARD_HEADS))
    elif kind == PHONE:
        form = int(len(set(digits)) > 2 and span.count("(") == span.count(")"))
        gaze = 0 if digits.endswith("0000000") else 2
    elif kind == NAME:
        form = int(len(span.split()) == 2)
        gaze = int(span.split()[0] in GIVEN_NAMES)
    elif kind == ID:
        form = int(not (digits.startswith(("000", "666", "9")) and len(digits) == 9))
    elif kind == SECRET:
        form = int(bits_a_character(span) >= 3 and not DASHED.fullmatch(span))
        gaze = 1 if span.startswith(KEY_HEADS) else 2
    if CUES[kind].search(before):
        context = 1
    else:
        context = 0 if {NAME: NAME_NO_CUES, SECRET: SECRET_NO_CUES}.get(kind, NO_CUES).search(before) else 2
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return [int(strict), form, gaze, context, int(not glued)]


def features_of(text: str, kind: int, start: int, end: int, votes: list[int]) -> int:
    """BITS of a span's shape and votes, and above them the bucket of the word before it."""
    span = text[start:end]
    word = LAST_WORD.search(text, max(0, start - 40), start)
    bucket = crc32(word[1].lower().encode("utf-8", "surrogatepass")) % ((1 << BUCKET_BITS) - 1) + 1 if word else 0
    bits = [
        len(span) > 16,
        any(c in " .-" for c in span),
        len(digits_of(span)) * 2 > len(span),
        end == len(text) or text[end] in ",.;:!?\n",
        votes[1] == 1,
        votes[2] == 1,
        votes[3] == 1,
        votes[3] == 0,
    ]
    return sum(bool(b) << i for i, b in enumerate(bits)) | bucket << BITS


def code_of(kind: int, votes: list[int], features: int) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v
    return code << FEATURES | features


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    features, rest = codes & ((1 << FEATURES) - 1), codes >> FEATURES
    votes = np.empty((len(codes), len(LABELERS)), int)
    for i in reversed(range(len(LABELERS))):
        rest, votes[:, i] = np.divmod(rest, 3)
    return rest, votes, features


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of yes for each vote pattern that occurs n times, and each labeler's P(yes | truth), by EM.

    It starts from the shares of yes among the votes given; counts are smoothed, so none is ever sure.
    """
    given, yes = votes < 2, votes == 1
    post = (yes.sum(1) + 0.5) / (given.sum(1) + 1)
    rate = np.empty((2, votes.shape[1]))
    for _ in range(rounds):
        for truth, w in enumerate((n * (1 - post), n * post)):
            rate[truth] = ((w[:, None] * yes).sum(0) + 1) / ((w[:, None] * given).sum(0) + 2)
        share = ((n * post).sum() + 1) / (n.sum() + 2)
        log = [
            (np.where(yes, np.log(rate[t]), np.log(1 - rate[t])) * given).sum(1) + np.log(p)
            for t, p in enumerate((1 - share, share))
        ]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return post, rate


def train(kind: np.ndarray, features: np.ndarray, target: np.ndarray, n: np.ndarray, steps: int = 300):
    """Logistic regression on kind and features, to soft targets; returns the probability of a (kind, features)."""

    def design(kind, features):
        bits = features[:, None] >> np.arange(BITS) & 1
        bucket = (features >> BITS)[:, None] == np.arange(1 << BUCKET_BITS)
        bits = np.concatenate([bits, bucket], axis=1)
        hot = kind[:, None] == np.arange(len(KINDS))
        return np.concatenate([hot, (hot[:, :, None] * bits[:, None, :]).reshape(len(kind), -1)], axis=1).astype(float)

    x, weight = design(kind, features), n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (weight * (p - target)) + 1e-6 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step.clip(-2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return lambda k, f: 1 / (1 + np.exp(-(design(k, f) @ w)))


def key_of(kind, code):
    """What the classifier sees of a code: kind and features. Of numbers, arrays and columns alike."""
    return kind * (1 << FEATURES) + (code % (1 << FEATURES))


def accepted_keys(counts: list[tuple[int, int]]) -> list[int]:
    """Keys of candidates that are spans, from (code, number of candidates) of the corpus."""
    if not counts:
        return []
    codes, n = np.array(sorted(counts)).T
    kind, votes, features = decode(codes)
    post = np.empty(len(codes))
    for k in np.unique(kind):
        of = kind == k
        post[of], _ = reliabilities(votes[of], n[of].astype(float))
    chance = train(kind, features, post, n.astype(float))(kind, features)
    return sorted(set(key_of(kind, codes)[chance >= ACCEPT].tolist()))


SPAN = "array<struct<kind:int,start:int,end:int,code:int>>"


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found) for each row: found has the strict spans with code -1, then every candidate with its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "code")]))
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                row = []
                for k, s, e, strict in candidates(text):
                    votes = votes_of(text, k, s, e, strict)
                    if strict:
                        row.append((k, s, e, -1))
                    row.append((k, s, e, code_of(k, votes, features_of(text, k, s, e, votes))))
                rows.append([dict(zip(("kind", "start", "end", "code"), r, strict=True)) for r in row])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["id", "found"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id long, found {SPAN}")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for each row, sorted arrays of struct(kind int, start int, end int), end exclusive.

    base are the spans by the fixed rules, spans these and those that the classifier adds. Offsets are code points. A
    null text is an empty one, without spans; repeated rows give repeated rows; an empty table gives none. Other
    columns are not read.
    """
    work = Workspace(docs.sparkSession, "pii")
    found = work.write(find_candidates(docs, id_col, text_col), "candidates")
    counts = found.select(F.explode("found.code").alias("code")).where("code >= 0").groupBy("code").count()
    accepted = accepted_keys([(r["code"], r["count"]) for r in counts.collect()])
    good = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<int>")

    def plain(keep):
        kept = F.filter("found", keep)
        return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.struct(x["kind"], x["start"], x["end"]))))

    base = plain(lambda x: x["code"] == -1)
    return found.select("id", base.alias("base"), plain(lambda x: (x["code"] == -1) | F.array_contains(good, key_of(x["kind"], x["code"]))).alias("spans"))


def listing(spans):
    """kind:start:end of each span of a sorted array column, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(one, ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span in the text replaced by its kind in angle brackets; other columns stay.

    Overlapping spans become one, named by the kind listed first. Spans are found and replaced by row, in one more pass
    over the texts; a null text stays null.
    """
    work = Workspace(docs.sparkSession, "pii")
    codes = find_candidates(docs, id_col, text_col).select(F.explode("found.code").alias("code")).where("code >= 0")
    counts = work.write(codes.groupBy("code").count(), "counts")
    accepted = frozenset(accepted_keys([(r["code"], r["count"]) for r in counts.collect()]))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(x.as_py(), accepted) for x in batch.column(at)]
            columns = [pa.array(texts, batch.schema.types[at]) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str | None, accepted: frozenset[int]) -> str | None:
    if not text:
        return text
    spans = []
    for k, s, e, strict in candidates(text):
        if not strict:
            votes = votes_of(text, k, s, e, strict)
            if key_of(k, features_of(text, k, s, e, votes)) not in accepted:
                continue
        spans.append((s, e, k))
    if not spans:
        return text
    merged: list[list[int]] = []
    for s, e, k in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1] = [merged[-1][0], max(e, merged[-1][1]), min(k, merged[-1][2])]
        else:
            merged.append([s, e, k])
    gaps = [text[: merged[0][0]], *[text[a[1] : b[0]] for a, b in pairwise(merged)], text[merged[-1][1] :]]
    return "".join(x + y for x, y in zip(gaps, [*[f"<{KINDS[k].upper()}>" for _, _, k in merged], ""], strict=True))
