"""The ten operators against brute force on small tables with nulls, ties, copies and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import exact_dedup, line_dedup, lm_scoring, mixing, packing, quality_classifier, quality_rules, simhash_dedup, substring_dedup, toxicity
from tessera.llm.queries import vocabulary_path
from tessera.llm.textstats import base_stats

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, kept boolean, n_words string, margin double, y int, _id string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=4, n=60):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta", "é", "ñandú", "x" * 30, "##", "of", "the", "1a", "ß"]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [line(9) for _ in range(4)]
    texts = ["", None, " ", "\n\n", "one", "one", " one ", "ONE", shared[0], shared[0] + "\n", "a b c d e f g h " * 9]
    while len(texts) < n:
        parts = [r.choice(shared) if r.random() < 0.4 else line(r.randint(0, 25)) for _ in range(r.randint(1, 6))]
        texts.append(("\n" if r.random() < 0.7 else "\r\n\t").join(parts))
    texts += texts[20:26] + [texts[30] + " tail"]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None]), len(t or ""), 7, True, "clash", 0.5, 1, "clash") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "documents")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows without an id, an id that repeats, a text that repeats."""
    path = str(tmp_path_factory.mktemp("t") / "odd")
    data = [(None, "same text here", None, None), (3, "same text here", "en", "a"), (3, "same text here", "en", "a"), (3, None, "en", None), (1, "other words " * 40, None, "a")]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(None, 1, None)], "doc_id long, quality int, toxic int")


def raw(text):
    return (text or "").encode()


def test_exact_groups_match_brute_force(docs, rows):
    norm = {r[0]: re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for digest in (exact_dedup.digests, lambda b: (exact_dedup.F.lit(1).cast("long"), exact_dedup.F.lit(2).cast("long"))):
        got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, block=8, digest=digest).collect()}
        assert len(got) == len(rows)
        for i, t in norm.items():
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(groups[t]), len(groups[t]), i == min(groups[t]))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {min(g) for g in groups.values()}


def brute_fingerprint(text, shingle=4):
    words = WORD.findall(raw(text).lower())
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    root = {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in fps}


def test_simhash_components_match_brute_force(docs, rows):
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = brute_components(fps, 4)
    for tree in (2048, 2):
        got = simhash_dedup.near_groups(docs, tree=tree).collect()
        assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == fps
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def brute_similar(texts, similarity=0.8, shingle=5):
    """The pairs of ids whose sets of shingles have this Jaccard similarity or more, and the smallest id each reaches."""
    sets = {}
    for i, t in texts.items():
        words = WORD.findall(raw(t).lower())
        sets[i] = {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()
    same = lambda a, b: a == b or len(a & b) / len(a | b) >= similarity
    pairs = [(i, j) for i, j in itertools.combinations(sorted(sets), 2) if same(sets[i], sets[j])]
    root = {i: i for i in sets}
    for _ in sets:
        before = dict(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return pairs, root


def edited(seed, n_base=24, copies=8):
    """Texts of 200 words and versions of them with some words replaced: similarities from about 0.4 to 1."""
    r, out = random.Random(seed), {}
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    for _ in range(n_base):
        words = [word() for _ in range(200)]
        for c in range(copies):
            now = list(words)
            for at in r.sample(range(200), c):
                now[at] = word()
            out[len(out)] = " ".join(now)
    return out


def planted(seed, groups, copies):
    """Groups of copies of a text of 200 words, each with one to six words replaced by words of its own."""
    r, out = random.Random(seed), {}
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(3, 8)))
    for _ in range(groups):
        base = [word() for _ in range(200)]
        for _ in range(copies):
            now = list(base)
            for at in r.sample(range(200), r.randint(1, 6)):
                now[at] = word()
            out[len(out)] = " ".join(now)
    return out


def fast_similar(texts, similarity=0.8, shingle=5):
    """The roots of ``brute_similar``, by counting shared shingles."""
    number, holders, sets = {}, [], []
    for i, t in texts.items():
        w = t.split()
        sets.append([number.setdefault(x, len(number)) for x in {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)}])
        holders += [[] for _ in range(len(number) - len(holders))]
        for x in sets[i]:
            holders[x].append(i)
    holders, size, parent = [np.array(h) for h in holders], np.array(list(map(len, sets))), list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, own in enumerate(sets):
        shared = np.bincount(np.concatenate([holders[x] for x in own]), minlength=len(sets))
        for j in np.flatnonzero(shared >= similarity * (size + size[i] - shared) - 1e-9).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def test_similar_groups_lose_next_to_no_copy(spark, tmp_path):
    texts = planted(5, 6, 150)
    texts |= {i + len(texts): t for i, t in planted(6, 1, 3000).items()}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_groups(spark.read.parquet(str(tmp_path / "t"))).collect()}
    want = fast_similar(texts)
    assert all(want[i] == want[c] for i, c in got.items())
    for own in (range(900), range(900, 3900)):
        removed, due = sum(i != got[i] for i in own), sum(i != want[i] for i in own)
        assert removed >= 0.99 * due, (removed, due)


def test_similar_groups_join_what_exact_similarity_joins(spark, tmp_path):
    texts = edited(3)
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    pairs, want = brute_similar(texts)
    assert len(pairs) > 100 and len(set(want.values())) < len(texts)
    for tree in (3, 2048):
        got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_groups(docs, tree=tree).collect()}
        assert set(got) == set(texts)
        # No group holds texts that the exact rule leaves apart.
        assert all(want[i] == want[c] for i, c in got.items())
        assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_open_groups_are_linked_by_all_their_texts_and_report_a_forest():
    """Two hundred texts that are alike to each other only over many others: every link counts, and none is reported twice."""
    sets = [np.arange(10 * k, 10 * k + 100, dtype=np.int64) for k in range(200)]
    rows = [(k, k, sets[k]) for k in range(200)]
    found = simhash_dedup.alike(rows, None, 0.8)
    assert len(found) == 199 and {b - a for a, b in map(sorted, found)} == {1}
    assert not simhash_dedup.alike(rows, None, 0.9)
    # Between two sides only links across count; what is together already is not reported.
    across = simhash_dedup.alike(rows[::2], rows[1::2], 0.8)
    assert len(across) == 199
    joined = [(k, 0 if k < 150 else k, sets[k]) for k in range(200)]
    assert len(simhash_dedup.alike(joined, None, 0.8)) == 50
    # Far texts come first by place: a limit on the neighbours looked at would lose the one that is alike.
    near = [(k, k, np.arange(70 + k, dtype=np.int64) if k < 60 else np.arange(1000, 1100, dtype=np.int64)) for k in range(62)]
    assert (60, 61) in {tuple(sorted(x)) for x in simhash_dedup.alike(near, None, 0.8)}


def test_fingerprint_keys_stay_the_same_while_the_corpus_grows(spark):
    """A corpus of any size up to 33 million fingerprints has the same number of rows a fingerprint under its keys."""
    assert simhash_dedup.SPARE == 2 and all(max(simhash_dedup.SPARE, simhash_dedup.spare_blocks(n, 4)) == 2 for n in (2, 47_000, 236_000, 15_000_000))
    seen = []
    real = simhash_dedup.links
    docs = spark.createDataFrame([(k, f"w{k} x{k * k} y z") for k in range(50)], "doc_id long, text string")
    simhash_dedup.links = lambda fps, radius, tree, spare: seen.append(spare) or real(fps, radius, tree, spare)
    try:
        simhash_dedup.near_groups(docs).count()
    finally:
        simhash_dedup.links = real
    assert seen == [2]


def test_drawn_keys_reach_pairs_at_the_similarity():
    r = np.random.default_rng(4)
    for n in (1_000, 200_000):
        masks = simhash_dedup.drawn_keys(n, 0.8).view(np.uint8)
        flips = r.random((2000, 256)) < simhash_dedup.differing(0.8)
        change = np.packbits(flips, axis=1, bitorder="little")
        shared = ((masks[None] & change[:, None]) == 0).all(2).any(1)
        assert shared.mean() > 0.92


def test_bk_tree_and_components_on_random_fingerprints(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {}
    for i in range(400):
        f = r.choice(base)
        for _ in range(r.randint(0, 5)):
            f ^= 1 << r.randrange(64)
        fps[i] = f
    tree = simhash_dedup.BKTree()
    for f in fps.values():
        tree.add(f)
    for f in list(fps.values())[:50]:
        assert sorted(tree.within(f, 4)) == [k for k, g in fps.items() if (f ^ g).bit_count() <= 4]
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps.values()}
    df = spark.createDataFrame([(signed[f],) for f in set(fps.values())], "fp long")
    want = brute_components(fps, 4)
    for spare in (1, 3):
        got = {x["node"]: x["root"] for x in simhash_dedup.components(simhash_dedup.links(df, tree=16, spare=spare)).collect()}
        for i in fps:
            for j in fps:
                a, b = signed[fps[i]], signed[fps[j]]
                assert (want[i] == want[j]) == (got.get(a, a) == got.get(b, b))


def test_block_keys_leave_no_pair_within_the_radius_apart():
    assert [simhash_dedup.spare_blocks(n, 4) for n in (0, 100_000, 200_000, 10**7, 10**10)] == [1, 1, 2, 2, 4]
    r = random.Random(2)
    for spare in (1, 2, 3):
        masks = simhash_dedup.key_masks(4, spare)
        for _ in range(300):
            change = sum({1 << b: None for b in r.sample(range(64), 4)})
            assert any(change & mask == 0 for mask in masks)


def brute_removed(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def test_substring_removal_matches_brute_force(docs, rows):
    texts = [raw(r[1]) for r in rows]
    want = dict(zip((r[0] for r in rows), brute_removed(texts, 30), strict=True))
    for limit in (1 << 20, 256):
        for r in substring_dedup.remove_repeats(docs, length=30, limit=limit, shard_bytes=2000).collect():
            data, gone = texts[r["doc_id"]], want[r["doc_id"]]
            spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
            assert (r["n_bytes"], r["n_removed"], len(r["spans"])) == (len(data), sum(gone), spans)
            assert bytes(r["kept"]) == bytes(b for b, g in zip(data, gone, strict=True) if not g)


def test_substring_removal_of_runs_and_passages_with_varied_surroundings(spark, tmp_path):
    r = random.Random(2)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = noise(90)
    texts = ["z" * 300, "zq" * 100] + [noise(r.randint(0, 80)) + passage[r.randint(0, 20) :] + noise(r.randint(0, 80)) for _ in range(25)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    want = brute_removed([t.encode() for t in texts], 40)
    for row in substring_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "d")), length=40).collect():
        assert row["n_removed"] == sum(want[row["doc_id"]])


def test_windows_of_a_hot_anchor_are_split_before_they_are_sorted(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage, sides, cuts = noise(30), [noise(25) for _ in range(4)], []
    texts = [noise(40) + r.choice(sides)[r.randint(0, 20) :] + passage + r.choice(sides)[: r.randint(5, 25)] + noise(40) for _ in range(150)]
    texts += [noise(30) + passage + noise(30) for _ in range(150)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    want = brute_removed([t.encode() for t in texts], 40)
    sort = substring_dedup._sorted_shards
    monkeypatch.setattr(substring_dedup, "_sorted_shards", lambda cut, *a: cuts.append(cut) or sort(cut, *a))
    for row in substring_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "d")), length=40, shard_bytes=1000).collect():
        data, gone = texts[row["doc_id"]].encode(), want[row["doc_id"]]
        assert bytes(row["kept"]) == bytes(b for b, g in zip(data, gone, strict=True) if not g)
    sizes = [x[1] for x in cuts[0].selectExpr("h", "length(body) as b").groupBy("h").sum("b").collect()]
    assert sizes and max(sizes) <= 1000


def brute_lines(rows):
    keyed = {i: [(line, line.strip(b" \t\n\x0b\x0c\r").lower()) for line in raw(t).split(b"\n")] for i, t in rows.items()}
    owners = collections.defaultdict(set)
    for i, lines in keyed.items():
        for _, k in lines:
            if len(k.decode()) >= 10:
                owners[k].add(i)
    out = {}
    for i, lines in keyed.items():
        kept = [line for line, k in lines if len(owners.get(k, ())) < 2 or min(owners[k]) == i]
        out[i] = (len(lines), len(lines) - len(kept), b"\n".join(kept).decode())
    return out


def test_line_dedup_matches_brute_force(docs, rows):
    want = brute_lines({r[0]: r[1] for r in rows})
    assert {r["doc_id"]: tuple(r)[1:] for r in line_dedup.dedup_lines(docs).collect()} == want


def test_line_index_insert_and_delete_are_reversible(docs):
    a, b = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    first = line_dedup.LineIndex.create(a, shard_keys=20)
    both = first.insert(b)
    state = lambda x: sorted(tuple(map(str, r)) for r in x.counts.drop("shard").collect())
    whole = line_dedup.LineIndex.create(docs, shard_keys=20)
    assert state(both) == state(whole)
    back = both.delete(b.select("doc_id"))
    assert state(back) == state(first)
    for index in (first, both, back):
        assert index.probe(index.counts.select("shard", "key")).where("not maybe").count() == 0
    gone = both.counts.join(back.counts.select("key"), "key", "left_anti").select("shard", "key")
    assert gone.count() > 0 and back.probe(gone).where("maybe").count() <= 1


def test_line_index_gets_more_shards_as_it_grows(docs, empty):
    grown = line_dedup.LineIndex.create(empty, shard_keys=10).insert(docs.where("doc_id < 30")).insert(docs.where("doc_id >= 30"))
    whole = line_dedup.LineIndex.create(docs, shard_keys=10)
    state = lambda x: sorted(map(tuple, x.counts.drop("shard").collect()))
    assert state(grown) == state(whole) and grown.refs.count() <= grown.shards * 10
    shards = {r["shard"] for r in grown.counts.collect()}
    assert len(shards) > 1 and shards == {r["shard"] for r in grown.filters.collect()}
    assert grown.probe(grown.counts.select("shard", "key")).where("not maybe").isEmpty()


def test_cuckoo_filter_holds_what_was_added():
    from tessera.llm.cuckoo import CuckooFilter, build

    r = np.random.default_rng(0)
    h = r.integers(0, 2**64, 5000, dtype=np.uint64)
    f = build(h)
    assert f.contains(h).all() and f.contains(r.integers(0, 2**64, 5000, dtype=np.uint64)).mean() < 0.01
    f.remove(h[:2500])
    again = CuckooFilter.load(f.dump())
    assert again.contains(h[2500:]).all() and again.contains(h[:2500]).mean() < 0.01


def test_mixing_meets_targets(docs, rows):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    sizes = {r[0]: len(WORD.findall(raw(r[1]))) for r in rows}
    assert {i: r["size"] for i, r in got.items()} == sizes
    assert all(r["taken"] <= 3 * r["size"] for r in got.values())
    by = collections.defaultdict(int)
    for r in rows:
        by[r[3]] += sizes[r[0]]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target = {s: 0.0 for s in by}
    free, left = set(by), float(sum(by.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * by[s]}
        if not over:
            break
        for s in over:
            target[s], left = 3.0 * by[s], left - 3 * by[s]
        free -= over
    target |= share
    for s in by:
        mine = [r for r in got.values() if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and abs(sum(r["taken"] for r in mine) - target[s]) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = collections.Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(raw(r["text"])))
    assert {i: n for i, n in words.items() if n} == {i: r["taken"] for i, r in got.items() if r["taken"]}


def test_mixing_order_follows_scaled_keys(docs):
    """Within a source, a smaller key is taken no later, whatever the buckets."""
    drawn = {r["doc_id"]: r for r in mixing.drawn(docs).collect()}
    for s in {r["source"] for r in drawn.values()}:
        taken = {r["doc_id"]: r["part"] for r in mixing.mix(docs).collect() if r["source"] == s}
        order = sorted((i for i in taken if drawn[i]["size"]), key=lambda i: (drawn[i]["key"], i))
        whole = [taken[i] == drawn[i]["size"] for i in order]
        assert whole == sorted(whole, reverse=True)


def test_packing_covers_every_id_once(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows}
    got = packing.pack(docs, vocabulary_path(), sequence=64, group=4).toPandas()
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() == len(ids[i]) == g["doc_tokens"].iloc[0]
        assert [zlib.crc32(ids[i][s : s + n].tobytes()) for s, n in zip(g["start"], g["length"], strict=True)] == g["ids_crc32"].tolist()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    total, sequences = got["length"].sum(), got["sequence_id"].nunique()
    assert sequences <= total / 64 + got["sequence_id"].floordiv(2**32).nunique()


def test_learning_words_does_not_walk_through_the_known_ones():
    import time

    def spent(encoder):
        began = time.process_time()
        for k in range(60):
            encoder.encode([f"word{k}"])
        return time.process_time() - began

    few, many = (packing.WordEncoder(vocabulary_path(), remembered=10**6) for _ in range(2))
    many.ids = {b"%d" % k: b"" for k in range(900_000)}
    assert spent(many) < 10 * spent(few) + 0.1


def test_words_learned_together_have_the_ids_of_the_tokenizer():
    encoder = packing.WordEncoder(vocabulary_path(), remembered=12)
    texts = ["don't 'S x<|endoftext|>y \x00 q\x1dz", "É'RE _a_b 12ab3 Straße, \u01c5 \u4e2d\u6587", "don't 'LL \u0301a İs ﬁ", "", None]
    want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for _ in range(2):
        assert encoder.encode(texts) == want and [encoder.encode([t])[0] for t in texts] == want


def test_packing_spreads_cost_and_fills():
    lengths = np.array(sorted([1 << (k % 9) for k in range(3000)], reverse=True))
    place, offset = packing.assign(lengths, 256)
    used = np.bincount(place, lengths)
    assert used.max() == 256 and (used < 256).sum() <= 256 and len(used) == -(-lengths.sum() // 256)
    cost = np.bincount(place, lengths + lengths**2 / 256)
    assert np.median(cost) <= cost.max()


def brute_stats(text):
    b = raw(text)
    words = WORD.findall(b)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit))


def test_statistics_match_brute_force(rows):
    for r in rows:
        assert base_stats(r[1]) == brute_stats(r[1])


def test_quality_rules_use_group_fences(spark, tmp_path):
    r = random.Random(3)
    words = ["some", "plain", "words", "that", "differ", "slightly", "in", "size"]
    data = []
    for i in range(400):
        source = "code" if i % 2 else "news"
        text = " ".join(r.choice(words) + ("#" if source == "code" and r.random() < 0.5 else "") + str(10_000 + i * 31 + k) for k in range(40))
        data.append((i, text, "en", source))
    data.append((400, " ".join(f"w{k}***" for k in range(40)), "en", "news"))
    data.append((401, "short", "en", None))
    data.append((402, None, None, "news"))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = {x["doc_id"]: (x["base_failed"], x["kept"]) for x in quality_rules.apply_rules(docs, min_group=50).collect()}
    assert all(kept[i] == (False, True) for i in range(400))
    assert kept[400] == (False, False) and kept[401] == (True, False) and kept[402] == (True, False)
    assert {x["doc_id"] for x in quality_rules.filter_documents(docs, min_group=50).collect()} == set(range(400))


def test_each_quality_rule_rejects_what_the_base_rules_keep(spark):
    plain = [f"word{i:03d}" for i in range(100)]
    lines = [" ".join(plain[k : k + 5]) for k in range(0, 100, 5)]
    planted = {
        "mean_word": " ".join(w * 4 for w in plain),
        "symbol_ratio": " ".join([*plain, *["a#b"] * 20]),
        "dup_line_ratio": "\n".join([f"{x}\nthe end" for x in lines[:10]]),
        "repeat_ratio": " ".join([*plain, *plain[:14]]),
    }
    docs = [(i, "\n".join(lines), "en", "news") for i in range(60)] + [(60 + k, x, "en", "news") for k, x in enumerate(planted.values())]
    rows = quality_rules.apply_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), min_group=10).collect()
    verdicts = {x["doc_id"]: (x["base_failed"], x["kept"]) for x in rows}
    assert all(verdicts[i] == (False, True) for i in range(60))
    assert {name: verdicts[60 + k] for k, name in enumerate(planted)} == dict.fromkeys(planted, (False, False))


def test_sketches_merge_and_bound_the_error(spark):
    r = random.Random(5)
    data = [(("en", "de")[i % 2], ("a", "b", "c")[i % 3], r.randint(20, 400), r.randint(100, 3000), 0, 0, 0, 1) for i in range(3000)]
    df = spark.createDataFrame(data, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    own = quality_rules.sketches(df, ["lang", "source"])
    merged, whole = quality_rules.merge(own, ["lang"]), quality_rules.sketches(df.drop("source"), ["lang"])
    key = lambda d: sorted(tuple(x) for x in d.collect())
    assert key(merged) == key(whole.select(*merged.columns))
    got = {x["lang"]: x["m"] for x in quality_rules.quantiles(merged, ["lang"], {"m": 0.5}).where("stat = 'mean_word'").collect()}
    for lang in ("en", "de"):
        exact = np.median([x[3] / x[2] for x in data if x[0] == lang])
        assert abs(got[lang] - exact) <= 0.03 * exact + 0.01


def test_rule_ensemble_learns_and_compiles(spark, tmp_path):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(80))
    bad = lambda: " ".join(r.choice(["win", "now"]) + "###" for _ in range(80))
    texts = [(i, good() if i % 3 else bad()) for i in range(300)]
    spark.createDataFrame([*texts, (300, None)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    model = quality_classifier.train(docs, marks)
    assert 0 < len(model.rules) < 40
    got = {x["doc_id"]: x for x in quality_classifier.score(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 3 > 0) and 0 <= got[i]["score"] <= 1 for i in range(300)) and got[300]["score"] is not None


def test_toxicity_catches_gapped_and_inserted_characters(spark, tmp_path):
    r = random.Random(8)
    part = ["th", "er", "on", "ing", "re", "an", "es", "ti", "ou", "ha", "nt", "st"]
    word = lambda: "".join(r.choice(part) for _ in range(r.randint(1, 4)))
    insults = ["idiot", "moron", "pathetic", "worthless"]
    data, marks = [], []
    for i in range(500):
        toxic = i % 4 == 0
        words = [word() for _ in range(60)]
        if toxic:
            words[r.randrange(60)] = r.choice(insults)
        data.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    clean = " ".join(word() for _ in range(60))
    data += [(1000, clean + " you idxiot"), (1001, clean + " p.a.t.h.e.t.i.c"), (1002, clean + " wor-thless!"), (1003, clean), (1004, None), (1005, "")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) / len(held) > 0.95
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005)] == [1, 1, 1, 0, 0, 0]


def test_string_kernel_matches_its_definition():
    from itertools import combinations

    alphabet = toxicity.Alphabet.of(["idiot", "idxiot", "banana"])

    def vector(w):
        codes, out = alphabet.encode(w), collections.Counter()
        for at in combinations(range(len(codes)), 3):
            out[tuple(codes[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    def brute(a, b):
        x, y = vector(a), vector(b)
        dot = lambda p, q: sum(v * q[k] for k, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    for a in ("idiot", "idxiot", "banana"):
        for b in ("idiot", "banana"):
            assert toxicity.kernel(a, b, alphabet) == pytest.approx(brute(a, b), abs=1e-5)


def test_network_gradients_match_differences():
    from tessera.llm import gru

    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.initial(3, 4, 5, 4, np.arange(12.0)).items()}
    ids, keep = r.integers(0, 12, (6, 3)), r.random((6, 3)) > 0.2
    target, valid, h = r.integers(0, 12, (6, 3)), r.random((6, 3)) > 0.1, r.standard_normal((3, 5))
    real, gru.np.float32 = np.float32, np.float64
    try:
        grads, _, _ = gru.window_gradients(p, ids, keep, target, valid, h)
        for name, g in grads.items():
            at = tuple(r.integers(0, n) for n in g.shape)
            before = p[name][at]
            p[name][at] = before + 1e-5
            up = gru.window_gradients(p, ids, keep, target, valid, h)[1]
            p[name][at] = before - 1e-5
            down = gru.window_gradients(p, ids, keep, target, valid, h)[1]
            p[name][at] = before
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name
    finally:
        gru.np.float32 = real


def test_network_likelihood_does_not_depend_on_lanes_or_windows():
    from tessera.llm import gru

    r = np.random.default_rng(1)
    p = gru.initial(3, 4, 6, 4, np.arange(12.0))
    docs = [r.integers(0, 12, r.integers(1, 40)) for _ in range(30)]
    a, b = gru.log_likelihoods(p, docs, 4, 7), gru.log_likelihoods(p, docs, 16, 64)
    assert np.allclose(a, b, rtol=1e-4)
    every = np.array([gru.log_likelihoods(p, [np.array([k])])[0] for k in range(12)])
    assert np.exp(every).sum() == pytest.approx(1.0, abs=1e-5)


def test_language_model_base_scores_and_gain(docs, rows):
    import math

    tok = lambda t: [*WORD.findall(raw(t).lower()), b"<end>"]
    counts = collections.Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update(tok(r[1]))
    n, v = sum(counts.values()), len(counts)
    for head in (300_000, 5):
        for x in lm_scoring.score(docs, head=head).collect():
            words = tok(rows[x["doc_id"]][1])
            assert x["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
            assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
            assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 7 == 2) and x["score"] < 0


def test_network_is_trained_once_on_every_training_document(docs, rows, monkeypatch):
    seen, weights = {}, []

    def recorded(df, name):
        seen[name] = materialize(df, name)
        return seen[name]

    def averages(parts, count):
        weights.append(parts.groupBy().sum("n").first()[0])
        return averaged(parts, count)

    materialize, averaged = lm_scoring.materialize, lm_scoring.averaged
    monkeypatch.setattr(lm_scoring, "materialize", recorded)
    monkeypatch.setattr(lm_scoring, "averaged", averages)
    monkeypatch.setattr(lm_scoring, "REPLICA_TOKENS", 20)
    total = lm_scoring.score(docs).first()["train_tokens"]
    dealt = seen["encoded-documents"].where("part is not null")
    assert sorted(x["doc_id"] for x in dealt.collect()) == [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    assert sum(len(x["ids"]) // 2 for x in dealt.collect()) == total == sum(weights)
    assert len(weights) == lm_scoring.ROUNDS and dealt.select("part").distinct().count() > lm_scoring.AVERAGES


def test_ties_at_the_end_of_the_head_are_broken(spark):
    counts = spark.createDataFrame([(b"w%d" % k, 9 if k < 3 else 2) for k in range(500)], "token binary, c long")
    for most in (2, 3, 100, 499, 500, 900):
        got = [bytes(r["token"]) for r in lm_scoring.head_tokens(counts, most).collect()]
        assert len(got) <= most and (most < 3 or {b"w0", b"w1", b"w2"} <= set(got)) and len(got) >= min(500, most) - 2


def test_averages_in_levels_are_the_mean_of_all(spark, monkeypatch):
    from tessera.llm import gru

    monkeypatch.setattr(lm_scoring, "AVERAGES", 2)
    parts = [({"w": np.full(2, k, np.float32)}, float(k % 5 + 1)) for k in range(lm_scoring.FAN * 3)]
    df = spark.createDataFrame([(k, n, gru.dump(p)) for k, (p, n) in enumerate(parts)], "part int, n double, params binary")
    got = lm_scoring.averaged(df, len(parts)).collect()
    assert len(got) == 1 and got[0]["n"] == sum(n for _, n in parts)
    assert gru.load(bytes(got[0]["params"]))["w"] == pytest.approx(gru.mean(parts)["w"], rel=1e-5)


def every_operator(docs, labels):
    yield "1", toxicity.classify(docs, labels)
    yield "2", simhash_dedup.near_groups(docs)
    yield "3", substring_dedup.remove_repeats(docs)
    yield "4", exact_dedup.exact_groups(docs)
    yield "5", lm_scoring.score(docs)
    yield "6", mixing.mix(docs)
    yield "7", packing.pack(docs, vocabulary_path())
    yield "8", quality_classifier.classify(docs, labels)
    yield "9", quality_rules.apply_rules(docs)
    yield "10", line_dedup.dedup_lines(docs)


def test_empty_tables(empty, labels):
    for name, df in every_operator(empty, labels):
        assert df.count() == 0, name
    for stage in (quality_rules.filter_documents, exact_dedup.drop_copies, simhash_dedup.keep_first, mixing.mixed_documents):
        got = stage(empty)
        assert got.columns == empty.columns and got.count() == 0


def test_rows_without_id_and_repeated_rows(odd, labels):
    for name, df in every_operator(odd, labels):
        rows = df.collect()
        if name != "7":
            assert len(rows) == 5, name
    exact = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(odd).collect()))
    assert exact == [(False, 1, 1, 1, True), (False, 3, 3, 1, True), (False, 3, 3, 3, False), (False, 3, 3, 3, True), (True, 0, 3, 3, False)]
    assert exact_dedup.drop_copies(odd).count() == 3
    assert simhash_dedup.keep_first(odd).count() == 3
    assert {r["component_id"] for r in simhash_dedup.near_groups(odd).collect() if r["doc_id"] is None} == {3}
    lines = line_dedup.dedup_lines(odd).collect()
    assert sorted(r["n_dropped"] for r in lines) == [0, 0, 0, 0, 1]
    assert quality_rules.filter_documents(odd).columns == odd.columns


def test_labels_without_use(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(i, 1, 1) for i in range(30)], "doc_id long, quality int, toxic int")
    for marks, want in ((none, 0.5), (ones, 1.0)):
        assert {round(r["score"], 2) for r in toxicity.classify(docs, marks).collect()} == {want}
        assert {round(r["score"], 2) for r in quality_classifier.classify(docs, marks).collect()} == {want}


def test_very_long_text(spark, tmp_path):
    r = random.Random(9)
    text = " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(200_000))
    spark.createDataFrame([(1, text, "en", "a"), (2, text + " x", "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert {x["n_removed"] for x in substring_dedup.remove_repeats(docs).collect()} == {len(text)}
    assert [x["group_size"] for x in exact_dedup.exact_groups(docs).collect()] == [1, 1]
    assert {x["component_id"] for x in simhash_dedup.near_groups(docs).collect()} == {1}
    assert packing.pack(docs, vocabulary_path()).agg({"length": "sum"}).first()[0] > 400_000
