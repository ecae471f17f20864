import random

from helpers import sql_rows, table_rows

from matchweave.llm import line_dedup


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = table_rows(line_dedup.op8_line_dedup(spark, sf))
    assert got == sql_rows(line_dedup.OP8_SQL, sf)
    assert sum(r[2] for r in got) > 0


def brute(docs, min_words=50):
    """docs: (doc_id, text), unique ids. All runs of lines with min_words words, not only the shortest ones."""
    spots, lines_of = {}, {}
    for doc_id, text in sorted((d for d in docs if d[0] is not None and d[1] is not None), key=lambda d: d[0]):
        lines = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(text.split("\n"))]
        lines_of[doc_id] = [(k, x, len(x.split())) for k, x in lines if x]
        for a, (_, x, _) in enumerate(lines_of[doc_id]):
            spots.setdefault(x, []).append((doc_id, a))
    gone = {d: set() for d in lines_of}
    for doc_id, lines in lines_of.items():
        for a in range(len(lines)):
            for other, b in spots[lines[a][1]]:
                if (other, b) >= (doc_id, a):
                    break
                n = 0
                there = lines_of[other]
                while a + n < len(lines) and b + n < len(there) and lines[a + n][1] == there[b + n][1]:
                    n += 1
                if sum(x[2] for x in lines[a : a + n]) >= min_words:
                    gone[doc_id] |= set(range(lines[a][0], lines[a + n - 1][0] + 1))
    out = []
    for doc_id, text in docs:
        lines = [] if text is None else text.split("\n")
        drop = gone.get(doc_id, set())
        new = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in drop)
        out.append((doc_id, len(lines), len(drop), new))
    return sorted(out, key=repr)


def test_rows_sharing_an_id_keep_their_own_lines(spark):
    run = "\n".join(" ".join(f"{c}{k}" for k in range(30)) for c in "rs")
    own = "a wholly different text\nsecond own line"
    rows = [(1, run), (2, run), (2, own), (2, own + "\n" + run), (None, run), (None, own), (3, run), (3, run)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 99, r.text) for r in got) == sorted([(1, run), (2, ""), (2, own), (2, own), (99, ""), (99, own), (3, ""), (3, "")])


def test_runs_and_odd_texts(spark):
    line = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    run = [line("r", 20), "  ", line("s", 20), line("t", 15)]
    docs = [
        (1, "\n".join(["alone", *run, "end"])),
        (2, "\n".join(["other", *(x + " " for x in run), "tail"])),
        (3, "\n".join(run[:3])),
        (4, line("z", 60)), (5, line("z", 60)), (6, "head\n" + line("z", 60) + "\n\nfoot"),
        (7, None), (8, ""), (9, "\n\n"), (10, "\n".join(["x"] * 300)), (11, "\n".join(["x"] * 49)),
        (12, line("z", 49)), (13, "\r\n".join(run)), (14, "q " * 100_000 + "\n" + "p"),
        (15, "\n".join([line("u", 30), line("v", 30), line("last", 5), "own"])), (16, "\n".join(["x y", line("u", 30), line("v", 30), line("last", 5), "else"])),
    ]
    frame = spark.createDataFrame([(*d, 7, "m") for d in docs], "doc_id long, text string, start int, mark string")
    got = line_dedup.dedup_lines(frame)
    assert got.columns == ["doc_id", "start", "mark", "text", "n_lines", "n_removed"]
    assert table_rows(got.select("doc_id", "n_lines", "n_removed", "text")) == brute(docs)


def test_shared_ids_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(55))
    frame = spark.createDataFrame([(1, text), (1, text), (2, text + "\nmore")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.text) for r in line_dedup.dedup_lines(frame).collect())
    assert got == [(1, 0, text), (1, 0, text), (2, 1, "more")]
    assert line_dedup.dedup_lines(frame.where("false")).count() == 0


def test_clashing_columns_keep_their_values(spark):
    names = ["gone", "gone_id", "given", "split", "id", "rank", "content", "n_lines"]
    text = " ".join(f"w{k}" for k in range(55))
    frame = spark.createDataFrame([(k, text, *(f"{n}{k}" for n in names)) for k in (1, 2)], ["doc_id", "text", *names])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    assert all(got[k][n] == f"{n}{k}" for k in (1, 2) for n in names[:-1])
    assert (got[1].n_lines, got[1].n_removed, got[2].n_removed, got[2].text) == (1, 0, 1, "")


def test_random_lines_equal_brute_force(spark):
    rng = random.Random(4)
    docs = [(k, "\n".join(rng.choice("abcdefg") * rng.randrange(1, 4) + " w" * rng.choice([1, 7, 24, 49]) for _ in range(rng.randrange(30)))) for k in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert table_rows(got.select("doc_id", "n_lines", "n_removed", "text")) == brute(docs)


def test_many_lines(spark):
    text = "\n".join(f"line {k} of a long table" for k in range(16_000))
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (2, "own\n" + text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in got) == [(1, 16_000, 0), (2, 16_001, 16_000)]
