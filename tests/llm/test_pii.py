import hashlib
import random
import re

from foliary.llm import pii_weak as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    text, out = text or "", []
    for k, (kind, rule) in enumerate(PLAIN.items()):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def strict(text):
    return sorted((k, s, e) for k, s, e, ok in P.candidates(text) if ok)


TEXTS = [
    "", "a@b.co", "a@b.co@d.ef", "a@b@c.de", "@x.y", "é.x@y.z-.q..r", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1 0255.001.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "+1 (988) 555-2485.", "+1+22 333 4444 55", "+123456789012345678",
    "😀 a@b.co 8.8.8.8", "9" * 3000, "1." * 3000, "+1" * 3000, "a" * 30000 + "@", "a@" * 5000, "0000000000000000000 1",
]


def test_strict_spans_equal_the_plain_rules():
    rng = random.Random(1)
    fuzz = ["".join(rng.choice("01249.+-() @ab%é@.\n") for _ in range(rng.randrange(80))) for _ in range(6000)]
    for text in [t for t in TEXTS if len(t) < 20000] + fuzz:
        assert strict(text) == brute(text), text


def test_long_runs_are_linear():
    for text in TEXTS:
        P.candidates(text * 10)


def test_em_finds_which_labelers_are_reliable():
    rng = random.Random(4)
    rates = [(0.95, 0.05), (0.9, 0.1), (0.5, 0.5)]
    rows = {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        v = tuple(int(rng.random() < r[not truth]) if rng.random() < 0.9 else 2 for r in rates)
        rows[v] = rows.get(v, 0) + 1
    import numpy as np

    post, rate = P.reliabilities(np.array(list(rows)), np.array(list(rows.values()), float))
    assert rate[1][0] > 0.85 > 0.15 > rate[0][0] and abs(rate[1][2] - rate[0][2]) < 0.15


def test_query_and_loose_spans(spark):
    lines = [f"Please call or phone (415) {i % 800 + 200}-{1000 + i}, " for i in range(200)]
    lines += [f"contact: email u{i}@mail.example.com or phone +1 (415) 555-{1000 + i}." for i in range(200)]
    lines += ["version 300.1.2.3 of it", None, "", "mail jane (at) host (dot) com " * 3]
    rows = [(i, t, "x") for i, t in enumerate(lines)] + [(0, lines[0], "x"), (None, "a@b.co", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = P.find_spans(docs).select("id", P.listing("base").alias("base"), P.listing("spans").alias("spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r["id"])
        want = [f"{P.KINDS[k]}:{s}:{e}" for k, s, e in brute(text)]
        assert r["base"] == ",".join(want)
        assert set(want) - {""} <= set(r["spans"].split(","))
    assert P.find_spans(docs.limit(0)).count() == 0
    clean = {r["doc_id"]: r["text"] for r in P.redact(docs.where("doc_id >= 200")).collect()}
    assert clean[200] == "contact: email <EMAIL> or phone <PHONE>." and clean[401] is None and clean[402] == ""


def test_digest(spark):
    from foliary.llm.queries import op1_pii_weak_supervision

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in op1_pii_weak_supervision(spark, "/root/testdata/sf0.01").collect():
        want = brute(docs[r["doc_id"]])
        text = ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for k, _, _ in want) for i in range(4)]


def planted():
    """(text, kind, span) with personal data or secrets, and texts that only look like it with kind None."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    of = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    names, last = sorted(P.GIVEN_NAMES), ["Keller", "Moreau", "Baker", "Vega", "Lindt"]
    out = []
    for _ in range(150):
        secret = rng.choice([of("0123456789abcdef", 40), of(letters, 32), "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + of(letters, 36)])
        out.append((f"then set {rng.choice(['token', 'api_key', 'password', 'secret'])} = \"{secret}\" and go on", "secret", secret))
        out.append((f"{rng.choice(['commit', 'sha256 digest', 'checksum'])} {of('0123456789abcdef', 40)} of the file", None, None))
        out.append((f"see https://example.org/{rng.choice(['how-to-bake-bread-in', 'the_best_places_of'])}-{rng.randrange(1990, 2020)} for more", None, None))
        name = f"{rng.choice(names)} {rng.choice(last)}"
        out.append((f"as was said, {rng.choice(['my name is', 'Dr.', 'Mrs.'])} {name}, at the door", "name", name))
        out.append((f"It was late. {rng.choice(['General Public License', 'Monday Morning', 'Old Town Hall', 'Western Front'])} of it", None, None))
        number = f"{rng.randrange(100, 665)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
        out.append((f"her ssn is {number}, she said", "id", number))
        out.append((f"serial order no {rng.randrange(900, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)} came", None, None))
        out.append((f"part 4111 1111 1111 {rng.choice([1112, 1113, 1114])} of the list", None, None))
    return out


def test_planted_spans_are_found_and_others_left(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["id"]: r["spans"] for r in P.find_spans(docs).select("id", "spans").collect()}
    hit = {k: [0, 0] for k in ("secret", "name", "id")}
    wrong = 0
    for i, (text, kind, span) in enumerate(rows):
        found = [(P.KINDS[x["kind"]], text[x["start"] : x["end"]]) for x in got[i]]
        if kind:
            hit[kind][0] += (kind, span) in found
            hit[kind][1] += 1
        wrong += len([x for x in found if x != (kind, span)])
    assert all(a >= 0.9 * b for a, b in hit.values()), hit
    assert wrong <= 0.1 * sum(a for a, _ in hit.values()), (wrong, hit)
    clean = {r["doc_id"]: r["text"] for r in P.redact(docs).collect()}
    assert all((span in clean[i]) == ((kind, span) not in [(P.KINDS[x["kind"]], rows[i][0][x["start"] : x["end"]]) for x in got[i]]) for i, (_, kind, span) in enumerate(rows) if kind)


def test_redaction_of_overlaps_repeats_and_empty_tables(spark):
    rows = [(1, "pay 1.2.3.4 by 4111 1111 1111 1111@b.co now", "k")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = P.redact(docs).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["found"] == "k" and got[0]["text"] == "pay <IP> by <EMAIL> now"
    assert P.redact(docs.limit(0)).collect() == []


def test_long_texts_without_spaces_are_linear():
    for text in ("aB3" * 200_000, "a-" * 200_000, "1_" * 200_000, "-----BEGIN " * 20_000):
        for k, s, e, ok in P.candidates(text):
            P.features_of(text, k, s, e, P.votes_of(text, k, s, e, ok))
