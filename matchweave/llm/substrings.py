"""Near-duplicate passages across documents from compact windows of min-hashes."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchweave.llm.common import bucketed, connected_components, discard, freeing_shuffles, written

#: Odd 64-bit multipliers, one per hash function, drawn once from a seeded generator.
_MULTIPLIERS = np.random.default_rng(42).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: What separates words, as in a class of a regular expression.
_BLANK = r"\x20\x09-\x0D"


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of all runs of `shingle` words; fewer words than that: none."""
    n = len(words) - shingle + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = np.zeros(n, dtype=np.uint64)
    for k in range(shingle):
        x = (x ^ words[k : k + n]) * _MULTIPLIERS[40 + k % 8]
        x ^= x >> np.uint64(29)
    return x


def text_shingles(text: bytes, shingle: int) -> np.ndarray:
    """Shingle hashes of a whole UTF-8 text, A-Z lower-cased."""
    return shingle_hashes(word_hashes(text.lower().split()), shingle)


def ordered(hashes: np.ndarray, function: int) -> np.ndarray:
    """The random order of the shingles under one function; never zero."""
    x = hashes * _MULTIPLIERS[function]
    x ^= x >> np.uint64(31)
    x *= _MULTIPLIERS[63 - function]
    return np.maximum(x ^ (x >> np.uint64(29)), np.uint64(1))


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of `width` values, from running minima within blocks, left and right."""
    n = len(values) - width + 1
    pad = np.full(-len(values) % width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks = np.concatenate([values, pad]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def last_below(values: np.ndarray) -> np.ndarray:
    """For every element the nearest one before it that is not greater: its left ancestor in the Cartesian tree.

    No value may be below the first. Every pointer starts at the neighbour and takes over its
    target's pointer until the target is small enough, so that pointers double their reach.
    """
    at = np.maximum(np.arange(len(values)) - 1, 0)
    left = np.flatnonzero(values[at] > values)
    while len(left):
        at[left] = at[at[left]]
        left = left[values[at[left]] > values[left]]
    return at


def compact_windows(hashes: np.ndarray, starts: np.ndarray, width: int, function: int):
    """(l, c, r) of the compact windows of at least `width` shingles, in documents laid end to end.

    `starts` holds each document's first position, then the end. Every passage within [l, r] that
    holds c has its minimum at c (the leftmost of equal ones): [l, r] is the subtree of c in the
    Cartesian tree of the document's values. The nodes whose subtrees have at least `width`
    positions are the minima of the sliding windows of that width; a node's ancestors are among them,
    so the tree of these nodes alone, each document between values below all others, gives the bounds.
    """
    none = np.zeros(0, dtype=np.int64)
    long = np.flatnonzero(np.diff(starts) >= width)
    if not len(long):
        return none, none, none
    bits = np.uint64(int(len(hashes)).bit_length())
    mixed = ((ordered(hashes, function) >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
    inside = np.zeros(len(hashes) + 1, dtype=np.int32)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long + 1] - width + 1, -1)
    low = sliding_minima(mixed, width)
    low = low[np.cumsum(inside)[: len(low)] > 0]
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    c = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    of = np.searchsorted(starts, c, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    fences = np.append(new, len(c))
    node = np.insert(low, fences, 0)
    before = np.insert(c, fences, np.append(starts[of[new]] - 1, -1))
    after = np.insert(c, fences, np.append(-1, starts[of[new] + 1]))
    real = node > 0
    l = before[last_below(node)] + 1
    r = after[len(node) - 1 - last_below(node[::-1])[::-1]] - 1
    return l[real], c, r[real]


def windows_of(texts: list[bytes], width: int, shingle: int, functions: int):
    """(text number, key, l, c, r) of all compact windows of the texts; a key is a function with its minimum."""
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    hashes = shingle_hashes(word_hashes([w for some in words for w in some]), shingle)
    del words
    lengths = np.maximum(counts - shingle + 1, 0)
    ends = np.cumsum(counts)
    whole = np.zeros(int(ends[-1]) + 1, dtype=np.int32)
    np.add.at(whole, (ends - counts)[lengths > 0], 1)
    np.add.at(whole, (ends - shingle + 1)[lengths > 0], -1)
    hashes = hashes[np.cumsum(whole)[: len(hashes)] > 0]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for f in range(functions):
        l, c, r = compact_windows(hashes, starts, width, f)
        of = np.searchsorted(starts, c, side="right") - 1
        key = ((hashes[c] ^ np.uint64(f + 1)) * _MULTIPLIERS[32]).view(np.int64)
        out.append((of, key, l - starts[of], c - starts[of], r - starts[of]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def supported_starts(doc: np.ndarray, first: np.ndarray, last: np.ndarray, needed: int):
    """(doc, a, b): the runs of passage starts that lie in windows of at least `needed` functions; doc is in order.

    Interval join over the hash functions: first and last are the starts of a window's passages of the
    least width, from max(l, c - width + 1) to min(c, r - width + 1). Each start lies in one window of
    every function, so that as many windows around it as `needed` are as many functions.
    """
    names, group = np.unique(doc, return_inverse=True)
    base = group.astype(np.int64) << 32
    at = np.concatenate([base + first, base + last + 1])
    step = np.concatenate([np.ones(len(doc), dtype=np.int64), np.full(len(doc), -1)])
    cuts, of = np.unique(at, return_inverse=True)
    full = np.cumsum(np.bincount(of, weights=step, minlength=len(cuts))) >= needed - 0.5
    edge = np.flatnonzero(np.diff(np.concatenate([[0], full.astype(np.int8), [0]])))
    a, b = cuts[edge[::2]], cuts[edge[1::2]] - 1
    return names[a >> 32], a & 0xFFFFFFFF, b & 0xFFFFFFFF


def window_hashes(hashes: np.ndarray, width: int, function: int) -> np.ndarray:
    """A hash of the sequence in every window of `width` shingles: a polynomial modulo 2**64, from running sums."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    base = int(_MULTIPLIERS[function])
    steps = np.array([[base], [pow(base, -1, 2**64)]], dtype=np.uint64).repeat(len(hashes), axis=1)
    steps[:, 0] = 1
    power, back = np.cumprod(steps, axis=1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * power)])
    x = (total[width:] - total[:-width]) * back[: len(hashes) - width + 1]
    return (x ^ (x >> np.uint64(31))) * _MULTIPLIERS[63 - function]


def first_holders(batches):
    """(doc_id, at, first) for batches of (key, doc_id, tag) sorted by all three: the first document of a window's content.

    A tag is 32 more bits of the content's hash, then the window's place; at is that place and the one
    in the first document. Contents whose further bits differ from the first row's stand for themselves,
    as if no other document had them.
    """
    low = 0xFFFFFFFF
    going = None
    for batch in batches:
        key, doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(key):
            continue
        new = np.concatenate([[going is None or key[0] != going[0]], key[1:] != key[:-1]])
        of = np.cumsum(new)
        first_doc, first_tag = (np.concatenate([[0 if going is None else going[k]], x[new]])[of] for k, x in ((1, doc), (2, tag)))
        going = key[-1], first_doc[-1], first_tag[-1]
        same = (first_tag >> 32 == tag >> 32) & (first_doc != doc)
        place = tag & low
        at = place << 32 | np.where(same, first_tag & low, place)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, at, np.where(same, first_doc, doc))], ["doc_id", "at", "first"])


def counted(batches, most: int):
    """(key, doc_id, run, n) for batches of (key, doc_id, run) sorted by key, in batches.

    n is the number of a key's rows, `most` where there are at least as many, and 0 where they are of
    one document. Rows wait only until that is known, or as long as they are of one document.
    """
    held: list[np.ndarray] | None = None
    going = None
    for batch in chain(batches, [None]):
        if batch is not None:
            cut = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if not len(cut[0]):
                continue
            cut = cut if held is None else [np.concatenate(x) for x in zip(held, cut, strict=True)]
        elif held is None:
            return
        else:
            cut = held
        key, doc, _ = cut
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        mixed = np.logical_or.reduceat(doc != np.repeat(doc[first], size), first)
        full = mixed & (size >= most)
        if key[0] == going:
            full[0] = True
        n = np.repeat(np.where(full, most, np.where(mixed, size, 0)), size)
        end = len(key) if batch is None or full[-1] else int(first[-1])
        held = [x[end:] for x in cut] if end < len(key) else None
        going = key[-1] if full[-1] else None
        if end:
            yield key[:end], cut[1][:end], cut[2][:end], n[:end]


def rare_shingles(
    doc: np.ndarray, pos: np.ndarray, shingle: np.ndarray, n: np.ndarray, width: int, similarity: float, wanted: np.ndarray | None = None, sized: bool = False
):
    """(shingle, doc, a, b): for runs of passage starts, the shingles by which another such passage is found.

    Rows are the shingles of supported passages in document order; n is a shingle's frequency, 0 where
    no other document has it. Of a window's W distinct shingles any close one misses at most
    W * (1 - similarity); windows with more of them unshared are left out, and any one more than that,
    here the rarest, must hold a shared one (prefix filter). Only the wanted starts are looked at.

    With `sized`, two more columns: the least W of the run, and how varied a partner may be so that it
    needs this shingle, `width` where a partner of W does. Two windows are close if they share
    similarity / (1 + similarity) of both their W, so that of equally varied ones the first
    1 + W * (1 - similarity) / (1 + similarity) do, and the rest is for less varied partners.
    """
    none = np.zeros(0, dtype=np.int64)
    nothing = (none,) * (6 if sized else 4)
    if len(doc) < width:
        return nothing
    at = np.arange(len(doc))
    order = np.lexsort((at, shingle, doc))
    again = (doc[order[1:]] == doc[order[:-1]]) & (shingle[order[1:]] == shingle[order[:-1]])
    back = np.full(len(doc), width)
    back[order[1:][again]] = np.minimum((order[1:] - order[:-1])[again], width)
    size, alone = distinct_counts(back, width), distinct_counts(back, width, n == 0)
    spare = np.floor(size * (1 - similarity) + 1e-9).astype(np.int64)
    place = pos - at
    whole = (doc[width - 1 :] == doc[: len(doc) - width + 1]) & (place[width - 1 :] == place[: len(doc) - width + 1])
    if wanted is not None:
        whole &= wanted[: len(whole)]
    start = np.flatnonzero(whole & (alone <= spare))
    if not len(start):
        return nothing
    by_rarity = np.lexsort((shingle, n))
    fresh = np.concatenate([[True], (n[by_rarity][1:] != n[by_rarity][:-1]) | (shingle[by_rarity][1:] != shingle[by_rarity][:-1])])
    rank = np.empty(len(doc), dtype=np.int64)
    rank[by_rarity] = np.cumsum(fresh) - 1
    key = shingle[by_rarity[fresh]]
    rank[n == 0] = len(key)
    views = np.lib.stride_tricks.sliding_window_view(rank, width)
    take = (spare + 1 - alone)[start]
    found_rank, found_start, found_reach = [], [], []
    share = similarity / (1 + similarity)
    for plain in (True, False):
        rows = np.flatnonzero((size[start] == width) == plain)
        if not len(rows):
            continue
        most = int(take[rows].max())
        held = views[start[rows]]
        held = np.sort(np.partition(held, min(most, width) - 1, axis=1)[:, :most] if plain else held, axis=1)
        new = np.ones(held.shape, dtype=bool)
        new[:, 1:] = held[:, 1:] != held[:, :-1]
        nth = np.cumsum(new, axis=1)
        chosen = new & (nth <= take[rows][:, None]) & (held < len(key))
        row, column = np.nonzero(chosen)
        at = start[rows[row]]
        missed = nth[row, column] - 1 + alone[at]
        reach = np.floor((size[at] * (1 - share) - missed) / share + 1e-9).astype(np.int64)
        found_rank.append(held[row, column])
        found_start.append(at)
        found_reach.append(np.where(reach >= size[at], width, reach))
    r, s, reach = (np.concatenate(x) for x in (found_rank, found_start, found_reach))
    lesser = reach < width
    order = np.lexsort((s, lesser, r))
    r, s, reach, lesser = r[order], s[order], reach[order], lesser[order]
    cut = np.flatnonzero(
        np.concatenate([[True], (r[1:] != r[:-1]) | (lesser[1:] != lesser[:-1]) | (s[1:] != s[:-1] + 1) | (doc[s[1:]] != doc[s[:-1]]), [True]])
    )
    a, b = s[cut[:-1]], s[cut[1:] - 1]
    out = key[r[cut[:-1]]], doc[a], pos[a], pos[b]
    return (*out, np.minimum.reduceat(size[s], cut[:-1]), np.maximum.reduceat(reach, cut[:-1])) if sized else out


def window_sums(flags: np.ndarray, width: int) -> np.ndarray:
    """How many flags are set in every window of `width`."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[width:] - total[:-width]


def distance_back(hashes: np.ndarray, width: int) -> np.ndarray:
    """How far before it each shingle occurred last, `width` at most."""
    order = np.argsort(hashes, kind="stable")
    back = np.full(len(hashes), width)
    same = hashes[order[1:]] == hashes[order[:-1]]
    back[order[1:][same]] = np.minimum((order[1:] - order[:-1])[same], width)
    return back


def distinct_counts(back: np.ndarray, width: int, flags: np.ndarray | None = None) -> np.ndarray:
    """How many distinct (flagged) shingles each window of `width` holds: one counts where it occurs first."""
    p = np.arange(len(back)) if flags is None else np.flatnonzero(flags)
    n = len(back) + 1
    enters = np.maximum(p - back[p] + 1, 0)
    return np.cumsum(np.bincount(enters, minlength=n) - np.bincount(p + 1, minlength=n))[: len(back) - width + 1]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def set_starts(hashes: np.ndarray, first: int, last: int, width: int) -> np.ndarray:
    """The window starts in [first, last] whose shingle set differs from that of the start before, and `first`."""
    n = last - first + 1
    span = hashes[first : last + width]
    order = np.argsort(span, kind="stable")
    same = span[order[1:]] == span[order[:-1]]
    following, before = np.full(len(span), 2 * len(span)), np.full(len(span), -1)
    following[order[:-1][same]], before[order[1:][same]] = order[1:][same], order[:-1][same]
    at = np.arange(n - 1)
    stays = (following[: n - 1] <= at + width) & (before[width : width + n - 1] >= at)
    return first + np.concatenate([[0], 1 + np.flatnonzero(~stays)])


def window_sets(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a span of windows, and for every window which of them it holds."""
    span = hashes[starts[0] : starts[-1] + width]
    values, of = np.unique(span, return_inverse=True)
    at, begin = np.arange(len(span)), starts - starts[0]
    steps = np.zeros((len(starts) + 1, len(values)), dtype=np.int32)
    np.add.at(steps, (np.searchsorted(begin, at - width + 1), of), 1)
    np.add.at(steps, (np.searchsorted(begin, at, side="right"), of), -1)
    return values, np.cumsum(steps[:-1], axis=0) > 0


def close_windows(mine: np.ndarray, other: np.ndarray, run, width: int, similarity: float, block: int = 512):
    """(first start, last start, start there, similarity) of the windows of a run pair that are close, best first.

    Every start of one run is compared with every start of the other: shared shingles of all window
    pairs are one matrix product of the windows' shingle sets. Neighbouring starts with one set count once.
    """
    a, b, ra, rb = run
    span, other_span = set(mine[a : b + width].tolist()), set(other[ra : rb + width].tolist())
    # No window has fewer distinct shingles than its width less the repeats of the whole span.
    least = 2 * width - (b + width - a - len(span)) - (rb + width - ra - len(other_span))
    if len(span & other_span) * (1 + similarity) < similarity * least - 1e-6:
        return []
    mine_starts, other_starts = set_starts(mine, a, b, width), set_starts(other, ra, rb, width)
    ends = np.append(mine_starts[1:] - 1, b)
    best, where = np.zeros(len(mine_starts)), np.zeros(len(mine_starts), dtype=np.int64)
    for k in range(0, len(mine_starts), block):
        values, x = window_sets(mine, mine_starts[k : k + block], width)
        for m in range(0, len(other_starts), block):
            there = other_starts[m : m + block]
            other_values, y = window_sets(other, there, width)
            _, i, j = np.intersect1d(values, other_values, assume_unique=True, return_indices=True)
            if not len(i):
                continue
            shared = np.rint(x[:, i].astype(np.float32) @ y[:, j].astype(np.float32).T).astype(np.float64)
            union = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - shared
            close = np.where(shared >= similarity * union, shared / union, 0.0)
            at = close.argmax(axis=1)
            top = close[np.arange(len(at)), at]
            better = np.flatnonzero(top > best[k : k + block])
            best[k + better], where[k + better] = top[better], there[at[better]]
    order = np.argsort(-best, kind="stable")
    return [(int(mine_starts[o]), int(ends[o]), int(where[o]), float(best[o])) for o in order if best[o] > 0]


def prepared(hashes: np.ndarray, width: int):
    """What a comparison needs of the other side: shingles, the distinct ones in order with their first
    places and whether they come again, distances to the place before, and each window's number of distinct ones."""
    values, where, times = np.unique(hashes, return_index=True, return_counts=True)
    back = distance_back(hashes, width)
    return hashes, values, where, times > 1, back, distinct_counts(back, width)


def best_windows(p: np.ndarray, q: np.ndarray, starts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shared, start there) for each of so many starts: the most points (p, q) that a window here, from
    its start on, and one window of the other side hold. p counts from the first start."""
    origin = int(q.min()) - width + 1
    grid = np.zeros((starts + width, int(q.max()) - origin + width + 1), dtype=np.int32)
    np.add.at(grid, (p + 1, q - origin + 1), 1)
    total = grid.cumsum(axis=0).cumsum(axis=1)
    held = total[width:, width:] - total[:-width, width:] - total[width:, :-width] + total[:-width, :-width]
    at = held[:starts].argmax(axis=1)
    return held[np.arange(starts), at], at + origin


def alike_passages(mine: np.ndarray, side, width: int, similarity: float) -> list[tuple[int, int, int]]:
    """(start, stop, start there), in shingles, of the passages of `mine` that are close to one of a prepared side.

    Every window of `width` shingles is judged against every window there: a passage is a run of
    starts whose windows reach the Jaccard similarity of the shingle sets. A window that has too few
    shingles anywhere there is refused by a count. Aligned equal shingles prove most of the others: n
    of `width` different ones shared are a similarity of n / (2 width - n) at least. Windows that are
    neither refused, nor proven, nor inside proven passages are compared with all windows: by counting
    the shingles at equal places where no shingle comes twice, else set by set.
    """
    other, values, where, again, other_back, there = side
    if len(mine) < width or len(other) < width:
        return []
    at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
    hit = values[at] == mine
    share, back = similarity / (1 + similarity), distance_back(mine, width)
    here = distinct_counts(back, width)
    least = np.maximum(similarity * here, share * (here + there.min())) - 1e-6
    left = distinct_counts(back, width, hit) >= least
    if not left.any():
        return []
    found: list[tuple[int, int, int]] = []
    place, enough = where[at], 2 * share * width - 1e-6
    shifts, count = np.unique((place - np.arange(len(mine)))[hit], return_counts=True)
    for d in shifts[count >= enough].tolist():
        low, high = max(0, -d), min(len(mine), len(other) - d)
        if high - low < width:
            continue
        equal = window_sums(mine[low:high] == other[low + d : high + d], width)
        good = equal == width
        near = equal >= enough
        if not (good == near).all():
            good |= near & (here[low : high - width + 1] == width) & (there[low + d : high + d - width + 1] == width)
        found += [(low + x, low + y + width, low + x + d) for x, y in runs_of(good)]
    for start, stop in merged(found):
        left[start : stop - width + 1] = False
    for x, y in runs_of(left):
        p = np.flatnonzero(hit[x : y + width])
        q = place[x + p]
        if (here[x : y + 1] == width).all() and not again[at[x + p]].any() and (y - x + width) * (q.max() - q.min() + 2 * width) < 4_000_000:
            shared, begin = best_windows(p, q, y - x + 1, width)
            begin = np.clip(begin, 0, len(other) - width)
            good = (shared >= enough) & (there[begin] == width)
            found += [(x + u, x + v + width, int(begin[u])) for u, v in runs_of(good)]
            reach = there < width
        else:
            reach = np.ones(len(there), dtype=bool)
        if not reach.any():
            continue
        reach &= distinct_counts(other_back, width, np.isin(other, mine[x : y + width])) >= np.maximum(least[x : y + 1].min(), similarity * there - 1e-6)
        for ra, rb in runs_of(reach):
            found += [(a, b + width, begin) for a, b, begin, _ in close_windows(mine, other, (x, y, ra, rb), width, similarity)]
    return found


def merged(spans) -> list[tuple[int, int]]:
    """(start, stop) of spans, overlapping ones merged."""
    out: list[list[int]] = []
    for start, stop, *_ in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(s, e) for s, e in out]


def link_classes(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(doc_id, other_id): components of each document's smallest link first, then of
    what other links there are between those, so that many links inside a class are looked at once."""
    near = written(connected_components(edges.groupBy("doc_id").agg(F.min("other_id").alias("other_id")), "doc_id", "other_id"))
    mine, other = (near.select(F.col("node").alias(k), F.col("component").alias(f"class_{k}")) for k in ("doc_id", "other_id"))
    named = edges.join(mine, "doc_id", "left").join(other, "other_id", "left")
    between = named.select(F.coalesce("class_doc_id", "doc_id").alias("a"), F.coalesce("class_other_id", "other_id").alias("b")).where("a != b").distinct()
    upper = written(connected_components(between, "a", "b"))
    over = upper.select(F.col("node").alias("component"), F.col("component").alias("top"))
    inner = near.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return inner.unionByName(upper.join(near.select("node"), "node", "left_anti"))


@freeing_shuffles
def repeated_passages(
    docs: DataFrame, min_words: int = 50, shingle: int = 5, similarity: float = 0.8, functions: int = 6, needed: int = 3, most: int = 4096
) -> DataFrame:
    """docs(doc_id, text) -> one row per row: doc_id, class_id, repeats, n_passages, passages, sources.

    A passage of min_words words (min_words - shingle + 1 shingles) repeats if another document holds
    one whose shingle sets have at least the given Jaccard similarity. A longer passage above the
    similarity holds such a window, as its differing shingles cannot all be dense.

    Every document lists its compact windows under each hash function. Windows whose minimum no other
    document has are dropped; an interval join within the document finds the passages that lie in
    windows of `needed` functions. What an earlier document has word for word takes the first one as its
    source (first_holders), so that of equal windows one is left, however many there are. The rest is
    joined exactly, by its rarest shingles (rare_shingles): the documents that have one are its members; they are compared in rounds: with the first member, then with the next three, twelve and so on, as long
    as a passage of the member has no source yet; then those of one shingle that are still in different
    classes. So each repeated passage and each class is found, while copies cost one comparison each.
    Compared are whole documents, every window with every window (alike_passages).

    passages is "start:stop:doc:start there" in words, comma-joined, against smaller ids; sources are
    the documents it was verified against; class_id is the smallest document id reachable by verified
    repeats and exact copies. Of equal texts only the first is compared.

    Texts under min_words words, null texts and rows without an id have no passages and are their own
    class. The different texts of rows that share an id are one document, joined in their order by a
    word that holds the id.
    """
    spark, width = docs.sparkSession, min_words - shingle + 1
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = given.where("doc_id is not null and text is not null")
    # Only so many words are looked at, however long the text; mostly its beginning holds them.
    has_words = lambda text: text.rlike(rf"^[{_BLANK}]*+(?:[^{_BLANK}]++[{_BLANK}]++){{{min_words - 1}}}[^{_BLANK}]")
    long_enough = has_words(F.substring("text", 1, 2000)) | ((F.octet_length("text") > 2000) & has_words(F.col("text")))
    named = lambda texts: texts.select("doc_id", F.md5("text").alias("digest"), long_enough.alias("long_enough")).distinct()
    units = written(named(usable))
    several = written(units.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x < y").select("doc_id"))
    alike_ids = not several.isEmpty()
    one_each = usable if not alike_ids else (
        usable.join(several, "doc_id", "left_anti").unionAll(
            usable.join(several, "doc_id", "left_semi")
            .groupBy("doc_id")
            .agg(F.array_sort(F.collect_set("text")).alias("texts"))
            .select("doc_id", F.expr(r"array_join(texts, concat(' \u0001', doc_id, '\u0001 '))").alias("text"))
        )
    )
    none = F.array().cast("array<long>")
    if alike_ids:
        units = written(named(one_each))
    firsts = units.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    copies = written(units.join(firsts, "digest").where("doc_id != rep").select("doc_id", F.col("rep").alias("other_id"), "long_enough"))

    def emit(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > 1_000_000:
                    yield listed(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                yield listed(ids, texts)

    def listed(ids, texts):
        of, key, l, c, r = windows_of(texts, width, shingle, functions)
        a, b = np.maximum(l, c - width + 1), np.minimum(c, r - width + 1)
        # Windows that follow each other with one minimum, as in repeated words, are one.
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (a[1:] != b[:-1] + 1)]) if len(key) else np.zeros(0, dtype=bool)
        at, end = np.flatnonzero(new), np.append(np.flatnonzero(new), len(key))[1:] - 1
        columns = [key[at], np.array(ids, dtype=np.int64)[of[at]], a[at] << 32 | b[end]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "doc_id", "run"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = one_each.select("doc_id", F.col("text").cast("binary").alias("text")).join(copies, "doc_id", "left_anti")
    emitted = source.mapInArrow(emit, "key long, doc_id long, run long")

    def shared(batches):
        """Rows whose key two documents have: at most one key's rows of one document wait for the next batch."""
        for key, doc, run, n in counted(batches, 2):
            at = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(run[at])], ["doc_id", "run"])

    # Sorts by one number are radix sorts; what else must be in order is put so in the tasks' batches.
    dealt = emitted.repartition(parts, "key").sortWithinPartitions("key")
    met = dealt.mapInArrow(shared, "doc_id long, run long")

    def by_document(batches, columns: int, found):
        """found() of the rows of whole documents, which come sorted; a document may be cut between batches."""
        kept = None
        for batch in batches:
            cut = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
            if not len(cut[0]):
                continue
            cut = cut if kept is None else [np.concatenate(x) for x in zip(kept, cut, strict=True)]
            edge = int(np.searchsorted(cut[0], cut[0][-1]))
            kept = [x[edge:] for x in cut]
            if edge:
                yield found(*(x[:edge] for x in cut))
        if kept is not None:
            yield found(*kept)

    def spans(doc, run):
        """Starts that lie in windows of enough functions and, marked as whole, those that lie in windows of all."""
        some, every = (supported_starts(doc, run >> 32, run & 0xFFFFFFFF, n) for n in (needed, functions))
        columns = [np.concatenate(x) for x in zip(some, every, strict=True)]
        whole = np.repeat([False, True], [len(some[0]), len(every[0])])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, whole)], ["doc_id", "a", "b", "whole"])

    by_doc = met.repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    starts = written(by_doc.mapInArrow(lambda batches: by_document(batches, 2, spans), "doc_id long, a long, b long, whole boolean"))
    gathered = lambda kept: F.array_sort(F.collect_list(F.when(kept, F.struct("a", "b"))))
    spans_of = starts.groupBy("doc_id").agg(gathered(~F.col("whole")).alias("spans"), gathered(F.col("whole")).alias("equals"))

    def hashed(batches):
        for batch in batches:
            hashes = [text_shingles(text.as_py(), shingle).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(hashes, pa.binary()), batch.column("spans"), batch.column("equals")], ["doc_id", "hashes", "spans", "equals"]
            )

    runs_type = "array<struct<a:long,b:long>>"
    shingled = source.join(spans_of, "doc_id").select("doc_id", "text", "spans", "equals")
    # Shingles are dealt by document once; every later join by document finds them where they lie.
    body = bucketed(shingled.mapInArrow(hashed, f"doc_id long, hashes binary, spans {runs_type}, equals {runs_type}"), "doc_id", parts)
    discard(starts)

    def covered(hashes, runs, reach: int):
        """Which of the places lie in a run of starts, each with so many places after it."""
        inside = np.zeros(len(hashes) + 1, dtype=np.int64)
        for r in runs:
            inside[r["a"]] += 1
            inside[r["b"] + reach] -= 1
        return np.cumsum(inside)[:-1] > 0

    def shingles_in(value) -> np.ndarray:
        return np.frombuffer(value, dtype=np.uint64)

    def contents(batches):
        # A window that another document has word for word has its minima too, under every function.
        for batch in batches:
            for doc, value, runs in zip(batch.column("doc_id").to_pylist(), batch.column("hashes"), batch.column("equals"), strict=True):
                if not len(runs):
                    continue
                hashes = shingles_in(value.as_buffer())
                at = np.flatnonzero(covered(hashes, runs.as_py(), 1))
                key, more = (window_hashes(hashes, width, k)[at] for k in (20, 21))
                columns = [key.view(np.int64), np.full(len(at), doc), ((more >> np.uint64(33) << np.uint64(32)) | at.astype(np.uint64)).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "doc_id", "tag"])

    def held_before(batches):
        """The rows of first_holders whose content an earlier document has; the others are what is left of the spans."""
        for batch in first_holders(batches):
            yield batch.filter(pc.not_equal(batch.column("first"), batch.column("doc_id")))

    def same_runs(doc, at, first):
        """Runs of starts whose contents come one after the other in one first document."""
        order = np.lexsort((at, doc))
        doc, at, first = doc[order], at[order], first[order]
        place, there = at >> 32, at & 0xFFFFFFFF
        new = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (place[1:] != place[:-1] + 1) | (there[1:] != there[:-1] + 1)
        cut = np.flatnonzero(np.concatenate([[True], new, [True]]))
        a, b = cut[:-1], cut[1:] - 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[a], place[a], place[b], first[a], there[a])], ["doc_id", "a", "b", "other_id", "there"])

    by_content = body.select("doc_id", "hashes", "equals").mapInArrow(contents, "key long, doc_id long, tag long").repartition(parts, "key").sortWithinPartitions("key", "doc_id", "tag")
    holders = by_content.mapInArrow(held_before, "doc_id long, at long, first long").repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    runs = written(holders.mapInArrow(lambda batches: by_document(batches, 3, same_runs), "doc_id long, a long, b long, other_id long, there long"))
    # What an earlier document has word for word has its source; the rest is compared.
    place = F.struct(F.col("a").alias("start"), (F.col("b") + min_words).alias("stop"), "there")
    exact = written(runs.groupBy("doc_id", "other_id").agg(F.array_sort(F.collect_list(place)).alias("found")))
    fresh = body.drop("equals").join(runs.groupBy("doc_id").agg(gathered(F.lit(True)).alias("held")), "doc_id", "left")

    #: A run's length lies below this bit, which tells that its first shingles start wanted windows.
    begins = 1 << 31

    def shingles(batches):
        for batch in batches:
            for doc, value, runs, held in zip(batch.column("doc_id").to_pylist(), *(batch.column(c) for c in ("hashes", "spans", "held")), strict=True):
                hashes = shingles_in(value.as_buffer())
                wanted = covered(hashes, runs.as_py(), 1) & ~covered(hashes, held.as_py() or [], 1)
                at = np.flatnonzero(covered(hashes, [{"a": a, "b": b} for a, b in runs_of(wanted)], width))
                if not len(at):
                    continue
                kept, wanted = hashes[at].view(np.int64), wanted[at]
                first = np.flatnonzero(np.concatenate([[True], (kept[1:] != kept[:-1]) | (at[1:] != at[:-1] + 1) | (wanted[1:] != wanted[:-1])]))
                size = np.diff(np.append(first, len(at)))
                columns = [kept[first], np.full(len(first), doc), at[first] << 32 | size | np.where(wanted[first], begins, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "doc_id", "run"])

    def numbered(batches):
        for key, doc, run, n in counted(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, run, key, n)], ["doc_id", "run", "key", "n"])

    spread = fresh.mapInArrow(shingles, "key long, doc_id long, run long").repartition(parts, "key").sortWithinPartitions("key")
    placed = spread.mapInArrow(numbered, "doc_id long, run long, key long, n long")

    def rare(doc, run, key, n):
        order = np.lexsort((run, doc))
        doc, run, key, n = doc[order], run[order], key[order], n[order]
        pos, size, wanted = run >> 32, run & (begins - 1), run & begins > 0
        at = np.repeat(np.arange(len(run)), size)
        pos = pos[at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        found = rare_shingles(doc[at], pos, key[at], n[at], width, similarity, wanted[at], sized=True)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "doc_id", "a", "b", "size", "reach"])

    sorted_rows = placed.repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    windows = written(sorted_rows.mapInArrow(lambda batches: by_document(batches, 4, rare), "key long, doc_id long, a long, b long, size long, reach long"))
    rows_of = windows.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.min("size").alias("least"), F.count("*").alias("most_members"))
    several_docs = rows_of.where("x < y").select("key", "least", "most_members")
    grouped = (
        windows.join(several_docs, "key")
        .where("reach >= least")
        .groupBy("key", "doc_id", "most_members")
        .agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"))
    )
    nth = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    whole = written(grouped.select("key", "doc_id", "runs", nth.alias("nth"), "most_members"))
    discard(windows)
    discard(runs)
    sides = body.select("doc_id", "hashes")

    def verify(batches):
        other_id = side = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.other_id != other_id:
                    other_id, side = r.other_id, prepared(shingles_in(r.other_hashes), width)
                found = alike_passages(shingles_in(r.hashes), side, width, similarity)
                if found:
                    out.append((r.doc_id, r.other_id, [{"start": s, "stop": e + shingle - 1, "there": t} for s, e, t in sorted(found)]))
            yield pd.DataFrame(out, columns=["doc_id", "other_id", "found"])

    compared, passages = None, exact

    def compare(members: DataFrame, first: int, last: int, wanted) -> DataFrame:
        """Verify the wanted pairs of members with the first to last member of their key, once each; what was found."""
        nonlocal compared, passages
        heads = members.where(F.col("nth").between(first, last)).select("key", *(F.col(c).alias(f"head_{c}") for c in ("doc_id", "nth", "label")))
        pairs = members.where(F.col("nth") > first).join(heads, "key").where((F.col("nth") > F.col("head_nth")) & wanted)
        pairs = pairs.select("doc_id", F.col("head_doc_id").alias("other_id")).distinct()
        pairs = written(pairs if compared is None else pairs.join(compared, ["doc_id", "other_id"], "left_anti"))
        compared = pairs if compared is None else compared.unionAll(pairs)
        # A task's pairs are small and looked up, so that only the documents they name are sorted.
        others = sides.select(F.col("doc_id").alias("other_id"), F.col("hashes").alias("other_hashes")).join(
            pairs.select("other_id").distinct().hint("shuffle_hash"), "other_id", "left_semi"
        )
        joined = sides.join(pairs.hint("shuffle_hash"), "doc_id").join(others, "other_id")
        seen = written(joined.mapInPandas(verify, "doc_id long, other_id long, found array<struct<start:long,stop:long,there:long>>"))
        passages = passages.unionAll(seen)
        return seen

    def rest(members: DataFrame, last: int, keep) -> DataFrame:
        """Members of the keys in which a comparison is still due after the first `last` members were heads."""
        ahead = members.groupBy("key").agg(F.max("nth").alias("n"), keep.alias("keep")).where((F.col("n") > last + 1) & F.col("keep"))
        return written(members.join(ahead.select("key"), "key", "left_semi"))

    # First the members whose passages have no source yet: of a member's runs each round leaves those that it found none for.
    members, first, last = whole.withColumn("label", F.lit(True)), 1, 1
    while not members.isEmpty():
        seen = compare(members, first, last, F.col("label"))
        cover = (exact.unionAll(seen) if last == 1 else seen).groupBy("doc_id").agg(F.flatten(F.collect_list("found")).alias("cover"))
        held = lambda run: F.exists("cover", lambda p: (p["start"] <= run["a"]) & (run["b"] + min_words <= p["stop"]))
        left = F.when(F.col("cover").isNull(), F.col("runs")).otherwise(F.filter("runs", lambda run: ~held(run)))
        due = members.where(F.col("most_members") > last + 1).join(cover, "doc_id", "left").select("key", "doc_id", left.alias("runs"), "nth", "most_members")
        flagged = written(due.withColumn("label", F.size("runs") > 0))
        members = rest(flagged, last, F.max(F.when(F.col("nth") > last + 1, F.col("label"))))
        discard(flagged)
        first, last = last + 1, 4 * last
    # Then the members of one key that are still in different classes.
    links = written(passages.select("other_id", "doc_id"))
    groups = written(link_classes(links))
    classed = whole.drop("runs").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    members, first, last = classed.select("key", "doc_id", "nth", F.coalesce("component", "doc_id").alias("label")), 1, 1
    members = rest(members, 0, F.min("label") < F.max("label"))
    while not members.isEmpty():
        links = links.unionAll(compare(members, first, last, F.col("label") != F.col("head_label")).select("other_id", "doc_id"))
        members = rest(members, last, F.min("label") < F.max("label"))
        first, last = last + 1, 16 * last
    discard(body)
    groups = link_classes(written(links.unionAll(copies.where("long_enough").select("other_id", "doc_id"))))
    placed_in = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.col("other_id").alias("other_id"), x["there"].alias("there")))
    listed_by = passages.groupBy("doc_id").agg(
        F.array_sort(F.flatten(F.collect_list(placed_in))).alias("p"), F.array_sort(F.collect_set("other_id")).alias("sources")
    )
    text_of = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["start"], x["stop"], x["other_id"], x["there"])), ",")
    found = (
        units.join(firsts, "digest")
        .join(listed_by.withColumnRenamed("doc_id", "rep"), "rep", "left")
        .join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            "component",
            F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n_passages"),
            F.coalesce(text_of, F.lit("")).alias("passages"),
            F.when(
                F.col("component").isNotNull() & (F.col("rep") != F.col("doc_id")), F.array_sort(F.array_union(F.coalesce("sources", none), F.array("rep")))
            ).otherwise(F.coalesce("sources", none)).alias("sources"),
        )
    )
    return given.select("doc_id").join(found, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id",
        F.coalesce("component", "doc_id").alias("class_id"),
        F.col("component").isNotNull().alias("repeats"),
        F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"),
        F.coalesce("passages", F.lit("")).alias("passages"),
        F.coalesce("sources", none).alias("sources"),
    )


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, repeated passages and their sources of every document."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
