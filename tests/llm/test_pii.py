import hashlib
import math
import re
from collections import defaultdict

import regex

from matchweave.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}+"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_valid(kind, m):
    digits = re.sub(r"\D", "", m, flags=re.ASCII)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(docs, disclosure=0.9, support=2):
    texts = [t or "" for _, t in docs]
    base = []
    for t in texts:
        found = [
            (m.start(), k, m.end(), m[0]) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], t) if plain_valid(kind, m[0])
        ]
        base.append(sorted(found))
    words = [set(regex.findall(TERM, low(t))) for t in texts]
    n_t, joint, alone = defaultdict(int), defaultdict(int), defaultdict(int)
    entities = [{(kind, low(value)) for _, kind, _, value in b} for b in base]
    for row in range(len(docs)):
        for w in words[row]:
            n_t[w] += 1
        for e in entities[row]:
            alone[e] += 1
            for w in words[row]:
                joint[e, w] += 1
    n, extra = len(docs), defaultdict(set)
    telling = set()
    for (e, w), n_te in joint.items():
        n_e = alone[e]
        if n_te >= support and n_e < n and math.log(n_te * n / (n_t[w] * n_e)) >= math.log(n / n_e) * disclosure:
            telling.add((e, w))
    for row, t in enumerate(texts):
        mine = {w for w in words[row] if any((e, w) in telling for e in entities[row])}
        for m in regex.finditer(TERM, t):
            if low(m[0]) in mine and not any(s < m.end() and m.start() < z for s, _, z, _ in base[row]):
                extra[row].add((m.start(), 4, m.end()))
    out = []
    for row, (doc_id, _) in enumerate(docs):
        name = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        plain = [(a, k, b) for a, k, b, _ in base[row]]
        counts = [sum(k == j for _, k, _ in plain) for j in range(4)]
        digest = hashlib.sha256(name(plain).encode()).hexdigest()
        out.append((doc_id, *counts, digest, name([*plain, *extra[row]])))
    return sorted(out, key=repr)


def rows(df):
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows(pii.op4_pii(spark, sf))
    assert got == brute(docs)
    assert any("term:" in r[-1] for r in got)


def test_odd_texts(spark):
    docs = [
        (1, None), (2, ""), (3, "a@b.c@d.e x@y a@b.c_d@e.f .@-.- %@a.b.c.d"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.01 12.3 1.1.1.1"),
        (5, "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000 1 2 3"), (6, "+49 (0) 171 123-4567 +1 +12345678 +1..........2 +123456789012345678"),
        (7, "ä€😀 mail: Jörg@x.y.z 😀 4111111111111111 Zebra"), (8, "9" * 30_000 + " " + "1 " * 20_000 + "a@b" + ".c" * 20_000), (9, "x" * 100_000 + "@"),
        (10, "Contact Rumpelstilz at rumpel@castle.org or the office"), (10, "the office is open, the mail is not"), (None, "the office a@b.cc the office"),
        (11, "+1 234 567 8901 a@b.cc +1 234 567 8901" + " word" * 40), (12, "a" * 50 + " " + "b" * 60 + " q@w.ee " + "c" * 81),
    ] + [(100 + k, "the or at is open mail and office") for k in range(30)]
    frame = spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id long, text string, row string, spans int")
    got = pii.sanitized(frame)
    assert rows(got) == brute(docs)
    clean = {r.doc_id: r.sanitized for r in got.collect()}
    assert clean[1] is None and clean[7].startswith("ä€😀 ")
    assert pii.sanitized(frame.where("false")).count() == 0


def test_revealing_terms_are_generalised(spark):
    far = " and so on" * 30
    docs = [(k, f"Rumpelstilz{far} wrote: rumpel@castle.org, 李明{far} rumpelstilz") for k in (1, 2)]
    docs += [(k, "Write to us at once@office.org today or wrote and so on") for k in (3, 4)] + [(k, "Write to the office today wrote and so on") for k in range(5, 60)]
    docs += [(60, "only once: a@b.cc")]
    got = {r.doc_id: r.sanitized for r in pii.sanitized(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == f"[term]{far} wrote: [email], [term]{far} [term]"
    assert got[3] == "Write to [term] [term] [email] today or wrote and so on".replace(" or ", " [term] ")
    assert got[5] is None and got[60] == "only once: [email]"


def test_thousands_of_entities_in_one_text(spark):
    text = " ".join(f"user{k}@host{k}.org" for k in range(16_000))
    got = pii.sanitized(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].n_email == 16_000 and got[0].sanitized == " ".join(["[email]"] * 16_000)
