"""Personal data by pattern, and terms that give protected entities away by corpus co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.llm.common import written

KINDS = ["email", "ip", "card", "phone", "term"]
#: Possessive forms of the contract's patterns: no character that follows a run could have extended
#: it, so they match the same text without going back. A run that starts an email or ip has no
#: earlier start, except right after the previous match (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: What a text must hold for a pattern to be worth trying.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms are runs of letters of any script.
TERM, TERM_GAP = r"\p{L}+", r"\P{L}+"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    length = F.length(digits)
    places = F.sequence(F.lit(1), length)

    def add(total, k):
        d = F.substring(digits, k, F.lit(1)).cast("int")
        doubled = F.when((length - k) % 2 == 1, d * 2).otherwise(d)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = F.regexp_replace(match, r"[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def running(items: str, start: Column, carry, emit, kind: str, chunk=None, block: int = 256) -> Column:
    """[emit(state, item), ...] over an array column, the state carried on from item to item.

    Works in blocks, as an array that grows item by item would be copied whole each time. `items`
    is a column's name: an expression would be worked out anew for each block. With chunk(state,
    block), emit gets what that gives for a block and the block's first state as well.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda b: F.slice(items, b * block + 1, F.lit(block))
    )
    empty = F.array().cast(f"array<{kind}>")

    def step(acc, x):
        new = emit(acc["at"], x, acc["chunk"], acc["origin"]) if chunk else emit(acc["at"], x)
        kept = [acc[c].alias(c) for c in ("chunk", "origin") if chunk]
        return F.struct(carry(acc["at"], x).alias("at"), *kept, F.concat(acc["out"], F.array(new)).alias("out"))

    def head(acc, part):
        return F.struct(F.aggregate(part, acc["at"], carry).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def one(part, at):
        given = [chunk(at, part).alias("chunk"), at.alias("origin")] if chunk else []
        return F.aggregate(part, F.struct(at.alias("at"), *given, empty.alias("out")), step, lambda acc: acc["out"])

    heads = F.aggregate(blocks, F.struct(start.alias("at"), F.array_repeat(start, 0).alias("out")), head, lambda acc: acc["out"])
    return F.when(F.size(items) > 0, F.flatten(F.zip_with(blocks, heads, one))).otherwise(empty)


def matches(text: Column, pattern: str) -> Column:
    """A pattern's matches with the length of what stands before each: array<struct<gap, value>>.

    The pattern splits the text into matches and what lies between; their lengths add up to positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))


def located(items: str) -> Column:
    """A column of matches as array<struct<start, stop, value>> in code points, in order."""
    return running(
        items,
        F.lit(0),
        lambda at, m: at + m["gap"] + F.length(m["value"]),
        lambda at, m: F.struct((at + m["gap"]).alias("start"), (at + m["gap"] + F.length(m["value"])).alias("stop"), m["value"].alias("value")),
        "struct<start:int,stop:int,value:string>",
    )


def base_spans(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, text and the valid matches of each kind: array<struct<start, stop, value>>."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, none = F.col("text"), F.array().cast("array<struct<gap:int,value:string>>")

    def tried(kind: str) -> Column:
        hint = HINTS[kind]
        there = F.contains(text, F.lit(hint)) if hint else text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
        return F.when(there, matches(text, PATTERNS[kind])).otherwise(none)

    def checked(kind: str) -> Column:
        return F.filter(located(kind), lambda s: valid(kind, s["value"]))

    found = rows.select("doc_id", "text", *(tried(k).alias(k) for k in PATTERNS))
    return found.select("doc_id", "text", *(checked(k).alias(k) for k in PATTERNS))


def _tagged(kind: str) -> Column:
    return F.transform(
        F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop"))
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def revealing_terms(entities: DataFrame, words: DataFrame, spread: DataFrame, n_docs: int, disclosure: float, support: int) -> DataFrame:
    """(row, term): the terms of a document that give one of its entities away.

    entities(row, kind, value), words(row, term) of their documents, spread(term, n_t) of all documents.
    An entity e in n_e of N documents carries log(N / n_e). A term t in n_t documents, n_te of them
    with e, reveals log(n_te * N / (n_t * n_e)) of it, and is returned if that is at least
    `disclosure` of the whole. Estimates from under `support` documents don't count. As n_te is n_e
    at most, no term in more than n_e * (N / n_e) ** (1 - disclosure) documents can qualify: pairs are
    made of rarer terms only.
    """
    n = float(n_docs)
    known = entities.groupBy("kind", "value").agg(F.count("*").alias("n_e")).where(F.col("n_e").between(support, n_docs - 1))
    known = known.withColumn("most", F.col("n_e") * F.pow(n / F.col("n_e"), F.lit(1 - disclosure)) + 1e-6)
    rows = entities.join(known, ["kind", "value"])
    joint = (
        words.join(spread.where(F.col("n_t") >= support), "term").join(rows, "row").where("n_t <= most")
    )
    whole, shown = F.log(n / F.col("n_e")), F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e")))
    telling = (
        joint.groupBy("kind", "value", "term", "n_e", "n_t")
        .agg(F.count("*").alias("n_te"))
        .where((F.col("n_te") >= support) & (shown >= whole * disclosure))
    )
    return joint.join(telling.select("kind", "value", "term"), ["kind", "value", "term"], "left_semi").select("row", "term").distinct()


def sanitized(docs: DataFrame, disclosure: float = 0.9, support: int = 2) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the spans found, and `sanitized`: the text with them generalised, null where it stays.

    Base spans: email, ip, card and phone by pattern over the whole text. Then an
    information-theoretic pass: every distinct value is a protected entity; the words of the whole
    texts it occurs in, counted over all documents, show how strongly they give it away
    (revealing_terms). Every occurrence of a revealing term in such a text becomes a span of
    kind term, unless it overlaps a base span. Spans are replaced by their kind in brackets, terms
    removed to "[term]". Terms are runs of letters of any script and length.

    Document counts of all words come from one pass over all texts, combined per task before the
    shuffle; words are paired with entities only where both are rare enough to qualify. Null texts
    are empty; null and repeated ids are separate rows.
    """
    found_base = base_spans(docs).withColumn("row", F.monotonically_increasing_id())
    some = F.size(F.concat(*PATTERNS)) > 0
    numbered = written(found_base.withColumn("text", F.when(some, F.col("text"))))
    n_docs = numbered.count()
    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), F.translate(s["value"], UPPER, LOWER).alias("value")))

    listed = F.concat(*map(named, PATTERNS))
    entities = written(numbered.where("text is not null").select("row", F.explode(F.array_distinct(listed)).alias("e")).select("row", "e.*"))
    words_of = lambda text: F.explode(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), TERM_GAP, -1)))
    spread = docs.select(words_of(F.col("text").cast("string")).alias("term")).where("term != ''").groupBy("term").agg(F.count("*").alias("n_t"))
    words = numbered.where("text is not null").select("row", words_of(F.col("text")).alias("term")).where("term != ''")
    telling = revealing_terms(entities, words, spread, n_docs, disclosure, support)
    per_row = telling.groupBy(F.col("row").alias("term_row")).agg(F.collect_set("term").alias("telling"))
    base = F.array_sort(F.concat(*(_tagged(k) for k in PATTERNS)))
    joined = numbered.join(per_row, F.col("row") == F.col("term_row"), "left").select("*", base.alias("base"))
    none = F.array().cast("array<struct<gap:int,value:string>>")
    terms = joined.withColumn("terms", F.when(F.col("telling").isNotNull(), matches(F.col("text"), TERM)).otherwise(none)).withColumn("terms", located("terms"))
    free = F.filter(
        "terms",
        lambda t: F.array_contains("telling", F.translate(t["value"], UPPER, LOWER))
        & ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])),
    )
    tagged = F.transform(free, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("rank"), t["stop"].alias("stop")))
    spans = F.when(F.col("telling").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", tagged)))
    whole = terms.withColumn("spans", spans)
    names = F.array(*map(F.lit, KINDS))
    # What stands before a span, from the furthest end so far, and its kind; nothing for a span inside others.
    pieces = running(
        "spans",
        F.lit(0),
        lambda at, s: F.greatest(at, s["stop"]),
        lambda at, s, part, origin: F.when(s["stop"] <= at, F.lit("")).otherwise(
            F.concat(F.substring(part, at - origin + 1, F.greatest(s["start"] - at, F.lit(0))), F.lit("["), F.get(names, s["rank"]), F.lit("]"))
        ),
        "string",
        chunk=lambda at, block: F.substring("text", at + 1, F.greatest(F.array_max(F.transform(block, lambda s: s["stop"])) - at, F.lit(0))),
    )
    end = F.array_max(F.transform("spans", lambda s: s["stop"]))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join("pieces", ""), F.substring("text", end + 1, F.length("text"))))
    return whole.withColumn("pieces", pieces).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        clean.alias("sanitized"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of personal data, digest of the base spans and all spans of every document."""
    found = sanitized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
