import hashlib
import random
import re

import numpy as np
import pytest

from iotrail.llm import embedding_dups, exact_dedup, near_dups, sketch
from iotrail.llm.components import components


def normal(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_cuts_follow_content():
    rng = random.Random(1)
    base = bytes(rng.randrange(256) for _ in range(60_000))
    one, two = exact_dedup.chunks(base), exact_dedup.chunks(b"something in front of it" * 3 + base)
    assert b"".join(one) == base
    assert len(set(one) & set(two)) > 0.8 * len(one)
    assert exact_dedup.chunks(b"") == [] and exact_dedup.chunks(b"x") == [b"x"]
    assert max(map(len, exact_dedup.chunks(b"a" * 50_000))) <= exact_dedup.LONGEST


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(docs, clash, bits):
    """Three bits make names clash: the next seed has to be taken."""
    source = clash if bits == 64 else docs
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(normal(r.text), []).append(r)
    want = []
    for text, own in groups.items():
        keep = min(own, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id
        want += [(r.doc_id, keep, len(own), r.doc_id == keep, hashlib.sha256(text.encode()).hexdigest()) for r in own]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(source, bits=bits).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_short_names_clash(docs):
    rows = docs.select("doc_id", "text")
    assert exact_dedup.names_clash(rows, 1, 3) and not exact_dedup.names_clash(rows, 1)


def test_empty_tables(nothing, spark):
    assert exact_dedup.dedup(nothing).count() == 0
    assert near_dups.near_duplicates(nothing).count() == 0
    assert embedding_dups.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("chunk", [250_000, 7])
def test_components(spark, chunk):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(7, 7), (500, 501), (501, 500)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), chunk).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {x: got.get(x, x) for x in linked} == {x: root(x) for x in linked}


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= k:
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows, k):
    sets = {}
    for i, text in rows:
        sets[i] = shingles(text, k)
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("k,block,offers", [(4, 2000, near_dups.OFFERS), (5, 3, (1, None))])
def test_near_groups_equal_brute_force(spark, k, block, offers):
    """Chains of edits, exact copies, short texts; small blocks and few offers take every way through."""
    rng = random.Random(k)
    rows, words = [], [f"w{i}" for i in range(400)]
    for family in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "One two"), (len(rows) + 3, "one TWO\t"), (len(rows) + 4, "two one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(frame, k=k, block=block, offers=offers).collect()}
    assert got == brute(rows, k)


def test_near_groups_of_odd_rows(docs, clash):
    got = near_dups.near_duplicates(clash).collect()
    assert len(got) == docs.count()
    of = {r.doc_id: r for r in got}
    assert of[2].component_id == 1 and of[3].component_id == 1 and of[7].component_id == 7 and of[11].component_id == 10
    assert of[4].kept and of[5].kept and of[6].kept and of[None].component_id is None


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    ra, rb = sketch.registers(a), sketch.registers(b)
    assert (sketch.merged(ra, rb) == sketch.registers(np.union1d(a, b))).all()
    (estimate,) = sketch.jaccard_likelihood(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))
    assert abs(estimate - 1500 / 2500) < 0.12


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(40):
            base = rng.normal(size=16)
            rows += [(len(rows) + i, (base + rng.normal(size=16) * 0.12).astype("float32").tolist(), label) for i in range(rng.integers(1, 9))]
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(50)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + 6, rows[0][1], None), (n + 7, rows[0][1][:8], 0), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    usable = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows[: n + 8] if c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = {i: {j for j, w, d in usable if d == c and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98} | {i} for i, v, c in usable}
    comp = {i: i for i in near}
    for _ in range(len(near)):
        before = dict(comp)
        comp = {i: min(comp[j] for j in near[i]) for i in near}
        if comp == before:
            break
    for shard, block in ((8192, 4096), (20, 15)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dups.near_duplicates(frame, shard=shard, block=block).collect()}
        assert got == {i: ((len(near[i]) - 1, comp[i], comp[i] == i) if i in near else (0, i, True)) for i, _, _ in rows}
