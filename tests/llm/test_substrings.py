import random
import time

import numpy as np
import pyarrow as pa

from matchweave.llm import common
from matchweave.llm import substrings as op


def word_list(text):
    return (text or "").encode().lower().split()


def exact_repeats(docs, min_words=50):
    """Ids of documents that share an exact run of min_words words with another id."""
    seen = {}
    for doc_id, text in docs:
        w = word_list(text)
        for k in range(len(w) - min_words + 1):
            seen.setdefault(tuple(w[k : k + min_words]), set()).add(doc_id)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def test_compact_windows_are_subtrees():
    rng = np.random.default_rng(0)
    for width in (1, 7, 46):
        lengths = [300, 0, 5, 46, 90, 7, 120]
        hashes = rng.integers(0, 2**63, sum(lengths), dtype=np.uint64)
        hashes[50:120] = hashes[:70]
        hashes[400:420] = hashes[400]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        got = set(zip(*(x.tolist() for x in op.compact_windows(hashes, starts, width, 3)), strict=True))
        values = op.ordered(hashes, 3)
        want = set()
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            for c in range(a, b):
                left = max((k for k in range(a, c) if values[k] <= values[c]), default=a - 1)
                right = min((k for k in range(c + 1, b) if values[k] < values[c]), default=b)
                if right - left - 1 >= width:
                    want.add((left + 1, c, right - 1))
        assert got == want


def test_supported_starts_lie_in_enough_windows():
    rng = np.random.default_rng(1)
    doc = np.sort(rng.integers(0, 9, 200))
    first = rng.integers(0, 60, 200)
    last = first + rng.integers(0, 9, 200)
    got = {(int(d), s) for d, a, b in zip(*op.supported_starts(doc, first, last, 3), strict=True) for s in range(a, b + 1)}
    cover = {}
    for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in range(a, b + 1):
            cover[d, s] = cover.get((d, s), 0) + 1
    assert got == {k for k, n in cover.items() if n >= 3} and got


def test_counts_do_not_depend_on_batches():
    rng = random.Random(9)
    rows = sorted((rng.choice([1, 2, 2, 2, 3, 4, 5, 6, 6, 6, 6]), rng.choice([7, 8, 9]), k) for k in range(400))
    rows = [r for r in rows if r[0] != 4 or r[1] == 7] + [(7, 1, k) for k in range(30)] + [(8, 1, 1), (9, 1, 1), (9, 2, 1)]
    total = {}
    for key, doc, _ in rows:
        total.setdefault(key, []).append(doc)
    for most in (2, 5, 64, 10_000):
        want = [(*r, min(len(total[r[0]]), most) if len(set(total[r[0]])) > 1 else 0) for r in rows]
        for size in (1, 3, 50, 1000):
            batches = [
                pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + size], strict=True)], ["key", "doc_id", "run"]) for k in range(0, len(rows), size)
            ]
            got = [x for part in op.counted(batches, most) for x in zip(*(c.tolist() for c in part), strict=True)]
            assert got == want


def test_rare_shingles_are_the_prefix_of_every_window():
    rng, width = np.random.default_rng(2), 9
    doc = np.repeat([2, 3, 7], [60, 40, 8])
    pos = np.concatenate([np.arange(5, 45), np.arange(90, 110), np.arange(40), np.arange(8)])
    shingle = rng.integers(0, 40, len(doc))
    shingle[:25] = np.arange(100, 125)
    n = np.where(shingle % 9 == 0, 0, 1 + shingle % 5)
    got = set()
    for key, d, a, b in zip(*op.rare_shingles(doc, pos, shingle, n, width, 0.8), strict=True):
        got |= {(int(key), int(d), s) for s in range(a, b + 1)}
    at, want = {(d, p): (s, k) for d, p, s, k in zip(doc.tolist(), pos.tolist(), shingle.tolist(), n.tolist(), strict=True)}, set()
    for d, p in at:
        window = [at.get((d, p + k)) for k in range(width)]
        if None in window:
            continue
        shared, alone = {w for w in window if w[1]}, {w for w in window if not w[1]}
        spare = (len(shared) + len(alone)) // 5
        if len(alone) <= spare:
            want |= {(s, d, p) for s, _ in sorted(shared, key=lambda w: (w[1], w[0]))[: spare + 1 - len(alone)]}
    assert got == want and want


def test_exact_repeats_are_found(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = exact_repeats([(r.doc_id, r.text) for r in table.collect()])
    got = {r.doc_id: r for r in op.repeated_passages(table).collect()}
    flagged = {i for i, r in got.items() if r.repeats}
    assert want <= flagged
    texts = {r.doc_id: word_list(r.text) for r in table.collect()}
    for i, r in got.items():
        for p in filter(None, r.passages.split(",")):
            start, stop, other, there = map(int, p.split(":"))
            assert stop - start >= 50 and other < i and stop <= len(texts[i])
            x = {tuple(texts[i][k : k + 5]) for k in range(start, stop - 4)}
            y = {tuple(texts[other][k : k + 5]) for k in range(max(there, 0), there + stop - start - 4)}
            assert len(x & y) >= 0.5 * len(x | y)


def test_planted_passages(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, line = words(60), words(25)
    near = passage[:30] + ["changed"] + passage[31:]
    docs = [(k, " ".join(words(rng.randrange(20, 200)) + passage + words(rng.randrange(20, 200)))) for k in range(1, 40)]
    docs += [(50, " ".join(words(80) + near + words(9))), (51, " ".join(words(300))), (52, " ".join(words(49)))]
    docs += [(60 + k, " ".join(words(100) + line + words(100))) for k in range(30)]
    docs += [(90, docs[45][1]), (91, docs[45][1]), (92, docs[41][1]), (93, None), (94, ""), (None, docs[0][1]), (95, "q " * 50_000)]
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, first int, key string")
    got = {r.doc_id: r for r in op.repeated_passages(frame).collect()}
    assert len(got) == len(docs)
    assert {i for i, r in got.items() if r.class_id == 1} == {*range(1, 40), 50}
    assert {i for i, r in got.items() if r.repeats} == {*range(1, 40), 50, docs[45][0], 90, 91}
    assert got[91].sources == [docs[45][0]] and got[2].sources == [1] and got[51].sources == []
    assert op.repeated_passages(frame.where("false")).count() == 0


def test_every_window_of_a_pair_is_compared():
    rng, width, near = np.random.default_rng(3), 46, 0
    for trial in range(150):
        n = int(rng.integers(46, 60))
        passage = rng.integers(0, 2**63, n, dtype=np.uint64)
        changed = passage.copy()
        at, size = int(rng.integers(0, n - 5)), 5
        if trial % 3 == 0:
            changed = np.concatenate([changed[:at], rng.integers(0, 2**63, size, dtype=np.uint64), changed[at + 4 :]])
        elif trial % 3 == 1:
            changed = np.concatenate([changed[at:], changed[:at]])
        else:
            changed[at : at + size] = rng.integers(0, 2**63, size, dtype=np.uint64)
        pad = lambda: rng.integers(0, 2**63, 60, dtype=np.uint64)
        mine, other = np.concatenate([pad(), passage, pad()]), np.concatenate([pad()[:31], changed, pad()])
        sets = [[{*x[s : s + width]} for s in range(len(x) - width + 1)] for x in (mine, other)]
        want = [s for s, x in enumerate(sets[0]) if any(len(x & y) >= 0.8 * len(x | y) for y in sets[1])]
        got = op.alike_passages(mine, op.prepared(other, width), width, 0.8)
        assert bool(got) == bool(want)
        joined = op.merged(got)
        assert all(any(s <= x and x + width <= e for s, e in joined) for x in want)
        for start, stop, there in got:
            assert any(len(sets[0][s] & y) >= 0.8 * len(sets[0][s] | y) for s in range(start, stop - width + 1) for y in [sets[1][min(there + s - start, len(sets[1]) - 1)]])
        near += bool(want)
    assert near > 50
    words = np.resize(np.arange(3, dtype=np.uint64), 20_000)
    assert op.merged(op.alike_passages(words, op.prepared(words[1:], width), width, 0.8)) == [(0, 20_000)]


def test_near_repeats_of_fifty_words_are_found(spark):
    """Passages of 50 words with one word changed: similarity 41/51 where it stands in the middle."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, pairs = [], []
    for k in range(400):
        passage = words(50)
        changed = passage.copy()
        changed[rng.randrange(5, 45)] = "changed"
        docs.append((2 * k, " ".join(words(rng.randrange(90)) + passage + words(rng.randrange(90)))))
        docs.append((2 * k + 1, " ".join(words(rng.randrange(90)) + changed + words(rng.randrange(90)))))
        pairs.append((2 * k, 2 * k + 1))
    got = {r.doc_id: r for r in op.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = sum(got[b].class_id == a and got[b].sources == [a] for a, b in pairs)
    assert found >= 0.9 * len(pairs)
    assert all(r.class_id in (i, i - i % 2) for i, r in got.items())


def test_passages_that_repeat_their_own_words_are_found(spark):
    """Fifty different words against their first 44 and the first six again: as alike as the similarity asks, but less varied."""
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, pairs = [], []
    for k in range(150):
        passage = words(50)
        sides = [passage, passage[:44] + passage[:6]]
        for j, side in enumerate(sides[:: (-1) ** k]):
            docs.append((2 * k + j, " ".join(words(rng.randrange(30)) + side + words(rng.randrange(30)))))
        pairs.append((2 * k, 2 * k + 1))
    got = {r.doc_id: r for r in op.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[b].class_id == a for a, b in pairs) >= 0.9 * len(pairs)


def test_all_pairs_equal_brute_force(spark):
    """Classes of small documents against all pairs of windows; minima may miss links, never make any."""
    rng = random.Random(6)
    pool = [[f"p{k}x{rng.randrange(10**6)}" for _ in range(rng.randrange(45, 75))] for k in range(12)]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            part = list(rng.choice(pool))
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = f"e{rng.randrange(10**6)}"
            parts += part[rng.randrange(6) :] + [f"f{rng.randrange(10**9)}" for _ in range(rng.randrange(20))]
        docs.append((k, " ".join(parts)))
    hashed = {k: op.text_shingles(t.encode(), 5) for k, t in docs}
    sets = {k: [{*h[s : s + 46].tolist()} for s in range(len(h) - 45)] for k, h in hashed.items()}
    near = lambda a, b: any(len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b])
    links = {(a, b) for b in sets for a in sets if a < b and near(a, b)}
    label = {k: k for k in sets}
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r for r in op.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all((o, i) in links for i, r in got.items() for o in r.sources)
    assert sum(got[k].class_id == label[k] for k in label) >= 0.95 * len(label)
    assert sum(got[k].repeats == any(k in x for x in links) for k in label) >= 0.97 * len(label)


def test_texts_that_share_an_id_are_one_document(spark):
    words = lambda c: " ".join(f"{c}{k}" for k in range(60))
    docs = [(1, words("a")), (1, words("b")), (1, words("b")), (2, words("a")), (3, words("b")), (4, words("c"))]
    got = op.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, tuple(r.sources)) for r in got) == [(1, 1, ())] * 3 + [(2, 1, (1,)), (3, 1, (1,)), (4, 4, ())]


def test_copies_behind_smaller_documents_with_a_part_are_found(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, copies = [], []
    for group in range(30):
        passage = words(60)
        for k in range(20):
            at = rng.randrange(21)
            docs.append((group * 100 + k, " ".join(words(30) + passage[at : at + 40] + words(30))))
        copies.append((group * 100 + 50, group * 100 + 60))
        docs += [(i, " ".join(words(30 + i % 7) + passage + words(30))) for i in copies[-1]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in op.repeated_passages(frame).collect()}
    assert all(got[b].class_id == got[c].class_id and b in got[c].sources for b, c in copies)


def test_window_hashes_are_of_the_sequence():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, 3000)]
    hashes[2000:2300] = hashes[500:800]
    for width in (1, 2, 46):
        got = op.window_hashes(hashes, width, 20)
        sequence = [tuple(hashes[k : k + width].tolist()) for k in range(len(hashes) - width + 1)]
        assert len(got) == len(sequence)
        assert len(set(zip(got.tolist(), sequence, strict=True))) == len(set(got.tolist())) == len(set(sequence))
    assert len(op.window_hashes(hashes[:45], 46, 20)) == 0


def test_first_holders_do_not_depend_on_batches():
    rng = random.Random(10)
    rows = sorted({(rng.randrange(20), rng.randrange(4), rng.choice([0, 0, 0, 7]) << 32 | rng.randrange(50)) for _ in range(300)})
    want, first = [], {}
    for key, doc, tag in rows:
        head_doc, head_tag = first.setdefault(key, (doc, tag))
        same = head_doc != doc and head_tag >> 32 == tag >> 32
        place = tag & 0xFFFFFFFF
        want.append((doc, place << 32 | (head_tag & 0xFFFFFFFF if same else place), head_doc if same else doc))
    for size in (1, 3, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + size], strict=True)], ["key", "doc_id", "tag"]) for k in range(0, len(rows), size)]
        assert [x for b in op.first_holders(batches) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)] == want


def test_close_windows_share_a_shingle_that_each_needs_for_the_other():
    rng, width, close, lesser = np.random.default_rng(14), 46, 0, 0
    docs = []
    for k in range(60):
        base = rng.integers(0, 2**62, 46) if k % 6 == 0 else base
        x = base.copy()
        x[rng.integers(0, 46, rng.integers(0, 5))] = rng.integers(0, 2**62)
        if k % 2:
            cut = int(rng.integers(36, 46))
            x[cut:] = x[: 46 - cut]
        docs.append(x)
    doc, pos, shingle = np.repeat(np.arange(60), 46), np.tile(np.arange(46), 60), np.concatenate(docs)
    holders = {}
    for d, s in zip(doc.tolist(), shingle.tolist(), strict=True):
        holders.setdefault(s, set()).add(d)
    n = np.array([len(holders[s]) if len(holders[s]) > 1 else 0 for s in shingle.tolist()])
    rows = {}
    for key, d, a, b, size, reach in zip(*op.rare_shingles(doc, pos, shingle, n, width, 0.8, sized=True), strict=True):
        assert a == b == 0 and size == len(set(docs[d].tolist()))
        rows.setdefault(int(d), {})[int(key)] = int(reach)
        lesser += reach < size
    sets = [set(x.tolist()) for x in docs]
    for x in range(60):
        for y in range(x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                close += 1
                both = rows.get(x, {}).keys() & rows.get(y, {}).keys()
                assert any(rows[x][k] >= len(sets[y]) and rows[y][k] >= len(sets[x]) for k in both)
    assert close > 50 and lesser
    plain = np.arange(46)
    found = op.rare_shingles(np.zeros(46, dtype=np.int64), plain, plain, np.full(46, 2), width, 0.8, sized=True)
    assert len(found[0]) == 10 and (found[5] == width).sum() == 6


def test_near_copies_are_compared_with_few_others(spark, monkeypatch):
    """Eighty texts that each changed some words of one: before, windows without a source met most others."""
    rng = random.Random(15)
    text = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    docs = []
    for k in range(80):
        words = list(text)
        for _ in range(8):
            words[rng.randrange(300)] = f"e{rng.randrange(3)}"
        docs.append((k, " ".join(words)))
    pairs, kept = [], op.written

    def counted(frame):
        back = kept(frame)
        if back.columns == ["doc_id", "other_id"]:
            pairs.append(back.count())
        return back

    monkeypatch.setattr(op, "written", counted)
    got = op.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and all(r.repeats for r in got)
    assert sum(pairs) < 80 * 79 / 4


def test_texts_in_buckets_stay_where_they_lie(spark):
    texts = spark.range(500).selectExpr("id AS doc_id", "repeat('w ', 40) AS text")
    table = common.bucketed(texts, "doc_id", 4)
    pairs = spark.range(300).selectExpr("id AS doc_id", "id % 7 AS other_id").hint("merge")
    one = pairs.join(table, "doc_id")
    both = one.hint("merge").join(table.selectExpr("doc_id AS other_id", "text AS other_text"), "other_id")
    for frame, moves in ((one, 1), (both, 2)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == moves
    assert both.count() == 300
    name = table._matchweave_table
    common.discard(table)
    assert not spark.catalog.tableExists(name)


def test_shuffle_files_go_while_the_job_runs(spark):
    """Before, they stayed until the driver collected its garbage."""
    rng = random.Random(16)
    passage = " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))
    docs = spark.createDataFrame([(k, f"{passage} {k}") for k in range(20)], "doc_id long, text string")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, given = files(), spark.conf.get(key)
    op.repeated_passages(docs)
    assert spark.conf.get(key) == given
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left


def test_a_text_is_long_enough_from_fifty_words_on(spark):
    blanks = " \t\n\x0b\x0c\r"
    docs = []
    for k in range(40):
        words = [f"w{k}x{j} y" for j in range(49 + k % 2)]
        text = blanks[k % 6] * (k % 3) + "".join(w + blanks[j % 6] * (1 + j % 2) for j, w in enumerate(words))
        docs += [(2 * k, text.rstrip() if k % 5 else text), (2 * k + 1, text.rstrip() if k % 5 else text)]
    got = {r.doc_id: r for r in op.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.repeats} == {i for i, text in docs if len(text.encode().split()) >= 50}


def test_counts_do_not_depend_on_the_order_of_a_keys_documents():
    """Before, a key whose first and last row were of one document counted as that document's alone."""
    rng = random.Random(17)
    rows = sorted(((rng.randrange(12), rng.choice([7, 7, 8, 9]), k) for k in range(300)), key=lambda r: (r[0], r[2]))
    rows += [(20, 7, 0), (20, 8, 1), (20, 7, 2), (21, 7, 0), (21, 7, 1)]
    total = {}
    for key, doc, _ in rows:
        total.setdefault(key, []).append(doc)
    for most in (2, 5, 4096):
        want = [(*r, min(len(total[r[0]]), most) if len(set(total[r[0]])) > 1 else 0) for r in rows]
        for size in (1, 3, 1000):
            batches = [
                pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + size], strict=True)], ["key", "doc_id", "run"]) for k in range(0, len(rows), size)
            ]
            assert [x for part in op.counted(batches, most) for x in zip(*(c.tolist() for c in part), strict=True)] == want


def test_a_round_keeps_only_runs_without_a_source(spark, monkeypatch):
    """Before, every round looked all runs up in all passages found so far."""
    rng = random.Random(15)
    text = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    docs = []
    for k in range(30):
        words = list(text)
        for _ in range(8):
            words[rng.randrange(300)] = f"e{rng.randrange(3)}"
        docs.append((k, " ".join(words)))
    found, kept = [], op.written

    def looked(frame):
        back = kept(frame)
        if {"runs", "label"} <= set(back.columns):
            found.append([tuple(r) for r in back.selectExpr("label", "size(runs)").collect()])
        return back

    monkeypatch.setattr(op, "written", looked)
    op.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = [r for some in found for r in some]
    assert any(not label for label, _ in rows) and all(label == (size > 0) for label, size in rows)
