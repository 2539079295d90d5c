"""Every operator of the subpackage against brute force (LM scoring: its gradient, its probabilities, and that any layout
gives the same scores), on a fixture with nulls, empty and long texts, ties,
repeated rows, an empty table, and extra columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import components, exact_dedup, jaccard_join, lm_scoring, media, mixing, packing, preferences, quality, sharding, suffix_dedup

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()


def fixture():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base, passage = prose(120), prose(90)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, base.upper(), " ".join(near), prose(80) + " " + passage, passage + " " + prose(50), None, "", "   ", "two words", "two words", prose(3000), "ab " * 400, "é" * 500, prose(30), prose(40)]
    rows = [(i, t, ["s1", "s2", "s3", None][i % 4], "en", i) for i, t in enumerate(texts)]
    return [*rows, rows[4]]  # a repeated row


SCHEMA = "doc_id long, text string, source string, lang string, size int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").encode().translate(exact_dedup.LOWER)


def test_sharding(spark, docs, none):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 101)
    assert set(Counter(table).values()) <= {14, 15} and len(table) == 101
    assert sharding.drift(shards, [*shards, "s7"], 1009) < 0.3
    got = sharding.shard(docs, "doc_id", shards, 101).collect()
    assert len(got) == 17 and all(table[r["slot"]] == r["shard"] for r in got)
    assert all(r["slot"] == int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % 101 for r in got)
    assert sharding.shard(none, "doc_id", shards, 101).count() == 0
    free, claims, turn = set(range(101)), {}, [0] * 7
    orders = [[(sharding._number(f"offset {s}") + k * (sharding._number(f"skip {s}") % 100 + 1)) % 101 for k in range(101)] for s in shards]
    while free:  # the shards take turns, each with its first free preference
        for i in range(7):
            if free:
                slot = next(x for x in orders[i] if x in free)
                claims[slot] = i
                free.remove(slot)
    assert [claims[x] for x in range(101)] == table
    named = sharding.shard(docs.withColumnRenamed("doc_id", "slot"), "slot", shards, 101).collect()
    assert Counter(r["shard"] for r in named) == Counter(r["shard"] for r in got)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_exact_dedup(spark, docs, none):
    groups = {}
    for i, t, *_ in fixture():
        groups.setdefault(lower(t), []).append(i)
    want = Counter()
    for t, ids in groups.items():
        want.update((i, max(ids), len(ids), i == max(ids) and at == ids.index(max(ids)), hashlib.sha256(t).hexdigest()) for at, i in enumerate(ids))
    got = exact_dedup.classes(docs).collect()
    assert Counter(map(tuple, got)) == want and sum(r.kept for r in got) == len(groups)
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(docs).collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.classes(none).count() == 0
    odd = spark.createDataFrame([(5, "a", 1), (5, "A", 2), (None, "a", 3), (None, "b", 4), (5, "c", 5)], "doc_id long, text string, _rows int")
    odd = odd.withColumns({"row": odd["_rows"], "rep": odd["_rows"], "_keep": odd["_rows"]})
    left = exact_dedup.deduplicated(odd)
    assert left.columns == odd.columns and sorted(r["_rows"] for r in left.collect()) in ([1, 4, 5], [2, 4, 5])
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.classes(odd).collect()) == [(0, 1, True), (5, 1, True), (5, 3, False), (5, 3, False), (5, 3, True)]


def test_trie_shares_edges():
    root = exact_dedup._Node(b"")
    nodes = {k: exact_dedup.insert(root, k)[0] for k in (b"romane", b"romanus", b"romulus", b"rubens", b"", b"rom")}
    assert [*root.children] == [114] and root.children[114].label == b"r" and nodes[b""] is root
    assert nodes[b"rom"].label == b"om" and {c.label for c in nodes[b"rom"].children.values()} == {b"an", b"ulus"}
    for k, node in nodes.items():
        node.value = (0, 0, 1)
        assert exact_dedup.insert(root, k)[0] is node
    assert sorted(k for k, _ in exact_dedup.terminals(root)) == sorted(nodes)


@pytest.mark.parametrize("budget", [2000, 60_000, 1 << 30])
def test_trie_spills_by_subtree(tmp_path, budget):
    """Classes and deciding rows are right whatever goes to files; texts that all begin alike spill below their common edge."""
    rng = random.Random(1)
    keys = [b"common beginning " + bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(3000)]
    owner = exact_dedup.Owner(f"file://{tmp_path}", budget)
    rows = [(i, rng.choice([None, rng.randrange(500)]), rng.randrange(1, 4), k) for i, k in enumerate(keys)]
    for row in rows:
        owner.add(*row)
    assert bool(owner.spilled) == (budget < 1 << 20) and all(n is not owner.root for n in owner.spilled)
    want = {}
    for i, identifier, n, k in rows:
        best = want.setdefault(k, [(-2, 0), 0])
        best[0] = max(best[0], (-1 if identifier is None else identifier, -i))
        best[1] += n
    got = dict(owner.classes())
    assert len(got) == 3000
    for i, _, _, k in rows:
        (identifier, row), n = want[k]
        assert got[i] == (None if identifier < 0 else identifier, -row, n)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_jaccard_join(docs, none):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t, *_ in fixture()}
    part = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == 17 and all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), part[r.doc_id]) for r in got)
    assert jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_random_sets(spark):
    """Many sets near the threshold, compared pair by pair."""
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words[rng.randrange(3) :])))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(part)
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
        if before == part:
            break
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == part


def test_jaccard_links(spark, docs, monkeypatch):
    """Every link between different sets, those inside components too, and the links of every document."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(70)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(40, rows[3][1]), (41, "quite another text of some words"), (42, None)]
    sets = {i: frozenset(tuple((t or "").split()[k : k + 5]) for k in range(len((t or "").split()) - 4)) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    least = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    assert {(r.a, r.b): r.overlap for r in jaccard_join.links(df).collect()} == {(a, b): len(sets[a] & sets[b]) for a, b in want if a < b and sets[a] != sets[b] and least[sets[a]] == a and least[sets[b]] == b}
    assert {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(df).collect()} == {i: sum(a == i for a, _ in want) for i in sets}


def test_jaccard_repeated_and_null_identifiers(spark):
    """Rows with one identifier and different texts keep their own sets; the whole row stays, whatever its columns are called."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, 1), (5, b, 2), (7, a, 3), (None, b, 4), (None, a + " x", 5), (None, None, 6), (9, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 36, 5, 2), (5, 36, 5, 1), (7, 36, 5, 2), (None, 36, 5, 1), (None, 37, 5, 2), (None, 0, None, 0), (9, 0, 9, 0)], key=str)
    kept = jaccard_join.representatives(df.withColumns({"row": df["id"], "comp": df["id"], "doc": df["id"], "_id": df["id"]}))
    assert kept.columns == ["doc_id", "text", "id", "row", "comp", "doc", "_id"]
    assert sorted((r.id for r in kept.collect()), key=str) in ([1, 2, 6, 7],)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 100: 50, 200: 50}


def test_suffix_dedup(docs, none):
    texts = [(i, (t or "").encode()) for i, t, *_ in fixture()]
    seen = Counter(t[k : k + 400] for _, t in texts for k in range(len(t) - 399))
    want = {}
    for i, t in texts:
        covered = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                covered[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        want[i] = (len(t), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.deduplicate(docs).collect()
    assert len(got) == 17 and all(tuple(r)[1:] == want[r.doc_id] for r in got)
    assert sum(w[1] for w in want.values()) > 0 and suffix_dedup.deduplicate(none).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(400)]
    runs = [sorted(set(keys[i::5])) for i in range(5)]
    merged = list(suffix_dedup.merge([suffix_dedup.read_run(suffix_dedup.front_code([(k, b"") for k in r])) for r in runs]))
    assert [k for _, k, _ in merged] == sorted(k for r in runs for k in r)
    before = b""
    for shared, key, _ in merged:
        assert shared == suffix_dedup.common_prefix(before, key)
        before = key


def test_media(docs, none):
    got = media.media_columns(docs).collect()
    texts = {i: (t or "").encode() for i, t, *_ in fixture()}
    assert len(got) == 17
    for r in got:
        payload = media.padded(texts[r.doc_id])
        assert len(payload) % 192 == 0 and payload.startswith(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.width * r.height == len(payload)
        assert r.media_sha256 == hashlib.sha256(media.encode_png(payload)).hexdigest() and r.length == len(media.encode_png(payload))
    assert len({(r.shard, r.offset) for r in got}) == len({media.padded(t) for t in texts.values()})
    assert media.media_columns(none).count() == 0


def test_media_headers_only(docs, tmp_path):
    """Metadata columns come from header bytes alone: payloads that are overwritten do not matter to them, but to features."""
    import struct

    stored, folder = media.store(docs)
    places = media.addresses(stored)
    want = {r.digest: (r.width, r.height, r.bits) for r in media.metadata(places, folder).collect()}
    for r in places.collect():
        with open(f"{folder.removeprefix('file://')}/{r.shard}", "r+b") as f:
            f.seek(r.offset + media.HEADER)
            f.write(b"\0" * (r.length - media.HEADER))
    assert {r.digest: (r.width, r.height, r.bits) for r in media.metadata(places, folder).collect()} == want and want
    with pytest.raises(Exception):
        media.features(places, folder).collect()
    for payload in (media.padded(b""), media.padded(b"x" * 5000), media.padded("é".encode() * 300)):
        png = media.encode_png(payload)
        assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (192, len(payload) // 192)
        image = [payload[i : i + 192] for i in range(0, len(payload), 192)]
        cells = [[[b for y, line in enumerate(image) if y * 8 // len(image) == i for x, b in enumerate(line) if x * 9 // 192 == j] for j in range(9)] for i in range(8)]
        mean = [[sum(c) / max(1, len(c)) for c in row] for row in cells]
        bits = "".join(str(int(mean[i][j + 1] > mean[i][j] + 1e-9 or mean[i][j + 1] - mean[i][j] > 0)) for i in range(8) for j in range(8))
        assert media.feature(payload) == f"{int(bits, 2):016x}"


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s, *_ in fixture():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(s for s in sizes if s) + [None]
    weights = dict(zip(names, (5, 2, 1, 5), strict=True))
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s) / 2 + 1
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == 0


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in fixture()}
    got = packing.pack(docs).collect()
    places = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and 0 < r.length <= 2048
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, *_ in fixture())
    assert len(places) == -(-sum(r.length for r in got) // 2048) and packing.pack(none).count() == 0


ODD = ["a  b\n\n  c\n d \n\n", "\n x", "x \n", "  ", "\t a  b", "it's 'll  I'll\n'll", "\x00 a\x00b", "日本 語  x", "<|endoftext|> a 12 345", "x\x1c y", "a\r\n b\r\n\r\n  c", ""]


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(" \n\t'ab1. \x00é\x1c\xa0") for _ in range(rng.randrange(30))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(packing.encoder().ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(100):
        counts = {rng.randint(1, 40): rng.randint(1, 50) for _ in range(rng.randint(1, 15))}
        runs = packing.plan(counts, 40)
        assert len({s + i for *_, n, s, _ in runs for i in range(n)}) == len(_brute(counts, 40))


def _brute(counts, capacity):
    gaps = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= length]
        if fit:
            gaps[min(fit, key=gaps.__getitem__)] -= length
        else:
            gaps.append(capacity - length)
    return gaps


def test_quality_held_out(spark, none):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(60))
    bad = lambda: " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 4))) for i in range(0, 200)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.resample(docs, labels).filter("kept").collect()}
    assert not [i for i in range(400) if (i in kept) != bool(i % 4)]
    assert quality.resample(none, labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).count() == 402
    assert quality.kept_rows(docs, labels).columns == docs.columns


def test_quality_brute_force(spark):
    """Counts, weights, noise, ranks and the threshold, computed again in plain Python on a small table of buckets."""
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(["the", "Sea", "buy!!", "now", "42"]) for _ in range(rng.randrange(1, 30)))) for i in range(60)] + [(60, None), (61, ""), (5, "the the sea"), (None, "now")]
    labels = [(i, int(rng.random() < 0.5)) for i in range(0, 40)] + [(3, 1), (3, 0), (None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality.resample(df, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=64).collect()
    best = {}
    for i, y in labels:
        if i is not None:
            best[i] = max(best.get(i, 0), y)
    raw, target, grams = [0.0] * 64, [0.0] * 64, []
    for i, t in rows:
        bucket, _, n = quality.features([(t or "").encode()], 64)
        grams.append((i, bucket.tolist(), int(n[0])))
        for b in bucket.tolist():
            raw[b] += 1
            target[b] += best.get(i) == 1
    ratio = [np.log((y + quality.PSEUDO) / (x * sum(target) / sum(raw) + quality.PSEUDO)) for x, y in zip(raw, target, strict=True)]
    weights = Counter((i, n, round(sum(ratio[b] for b in bs), 9)) for i, bs, n in grams)
    assert Counter((r.doc_id, r.n_words, round(r.log_weight, 9)) for r in got) == weights
    for r in got:
        u = (int(hashlib.md5(f"gumbel 11:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        assert r.perturbed == pytest.approx(r.log_weight - np.log(-np.log(u)))
    order = sorted(got, key=lambda r: (-r.perturbed, r.doc_id is None, r.doc_id or 0))
    assert sorted(r["rank"] for r in got) == list(range(len(rows)))
    assert all(r["rank"] <= s["rank"] or r.perturbed == s.perturbed for r, s in zip(order, order[1:], strict=False))
    scored = [(r.log_weight, best[r.doc_id]) for r in got if r.doc_id in best]
    split = lambda t: np.mean([x >= t for x, y in scored if y]) + np.mean([x < t for x, y in scored if not y])
    k = sum(r.kept for r in got)
    assert {r["rank"] < k for r in got if r.kept} <= {True} and not [r for r in got if r["rank"] < k and not r.kept]
    edges = sorted(float(np.sinh(np.floor(np.arcsinh(x) * quality.BINS) / quality.BINS)) for x, _ in scored)
    cut = sorted((r.log_weight for r in got), reverse=True)
    threshold = (cut[k - 1] + (cut[k] if k < len(cut) else cut[k - 1] - 1)) / 2
    assert split(threshold) >= max(split(e) for e in edges) - 1e-9


def test_quality_keeps_columns(spark):
    df = spark.createDataFrame([(1, "good text", 1, 2), (1, "bad", 3, 4), (None, "x", 5, 6)], "doc_id long, text string, _id int, _kept int").withColumnRenamed("_id", "row")
    kept = quality.kept_rows(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in df.collect()}


def test_lm_any_layout(spark):
    """The network, and so every score, is a matter of the documents, not of how they lie in partitions."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(60)))) for i in range(300)] + [(None, "alpha beta"), (7, None), (7, "beta")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [sorted((str(r.doc_id), r.n_tokens, round(r.log_likelihood, 6)) for r in lm_scoring.score(x).collect()) for x in (df.coalesce(1), df.repartition(7), df.orderBy(F.rand(3)))]
    assert scores[0] == scores[1] == scores[2]


def test_lm_shards_follow_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_WORDS", 500)
    rows = [(i, " ".join(WORDS[(i + k) % 24] for k in range(100))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted((r.doc_id, round(r.log_likelihood, 6)) for r in lm_scoring.score(x).collect()) for x in (df.coalesce(1), df.repartition(5)))
    assert a == b


def test_lm_scoring(spark, docs, none):
    got = lm_scoring.score(docs, sketch=1 << 10).collect()
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in fixture()}
    assert len(got) == 17 and all(r.n_tokens == n[r.doc_id] and (r.log_likelihood < 0) == (n[r.doc_id] > 0) for r in got)
    assert lm_scoring.score(none).count() == 0
    rng = random.Random(7)
    ordered = [" ".join(WORDS[(s + k) % 24] for k in range(200)) for s in range(60)]
    shuffled = " ".join(rng.sample(ordered[0].split(), 200))
    rows = [(i, t) for i, t in enumerate([*ordered * 4, shuffled])]
    scores = {r.doc_id: r.mean_log_likelihood for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert scores[240] < min(v for k, v in scores.items() if k < 240)


def test_lm_words_have_their_own_probability(spark):
    """Words of one class differ by their counts in the corpus, whether these are held by every task or joined."""
    common, rare = " ".join(["ca"] * 3 + ["cb"] * 3), " ".join(f"r{i}" for i in range(6))
    rows = [(i, "top " * 400) for i in range(3)] + [(i, common) for i in range(10, 50)] + [(90, rare)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: r.log_likelihood for r in lm_scoring.score(df, sketch=k, frequent=1, classes=1).collect()} for k in (1 << 18, 3, 0)]
    assert got[0][10] - got[0][90] == pytest.approx(6 * np.log(120))  # ca and cb occur 120 times, the others once
    assert all(g == pytest.approx(got[0], abs=1e-6) for g in got)
    tokens = lm_scoring.Vocabulary(np.array([7]), np.array([7, 8, 9, 10]), np.array([9, 4, 3, 1]), np.array([5, 3]), 1)
    words = np.array([8, 9, 10])
    within, missing = tokens.log_within(words, tokens.tokens(words))
    assert not missing.any() and np.allclose(np.exp(within), [4 / 5, 1, 1 / 5])


def test_lm_gradient_and_probabilities():
    net = lm_scoring.Network(6, 3)
    centre, around = np.array([1, 2, 5]), lm_scoring.windows(np.array([1, 2, 5]), np.array([0, 3]), 6)
    assert around.tolist() == [[6, 6, 1], [6, 1, 2], [2, 5, 6], [5, 6, 6]]
    assert np.allclose(net.probabilities(net.hidden(around)).sum(1), 1, atol=1e-6)
    before = net.log_likelihood(centre, around).sum()
    squares = [np.full(s, 1e-4, np.float32) for s in net.shapes]
    for _ in range(50):
        net.train(centre, around, squares)
    assert net.log_likelihood(centre, around).sum() > before / 4


def test_preferences(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "short"), (2, 0, "user", "q"), (2, 1, "assistant", "a longer answer"), (3, 0, "user", "alone"), (3, 1, "assistant", None), (4, 0, "user", "q"), (4, 1, "assistant", "short")]
    got = preferences.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    # sorted by content, then identifier: 2, 1, 4 share an opening
    assert sorted((r.chosen_id, r.rejected_id or 0) for r in got) == [(2, 1), (3, 0), (4, 0)]
    for r in got:
        for side, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for span in (mask or "").split(",") if mask else []:
                a, b = map(int, span.split("-"))
                assert side[a:b].endswith("<|end|>\n") and "<|assistant|>" not in side[a:b]
    assert preferences.preference_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_packing_many_of_one_length(spark):
    """A flood of one-token documents among others: runs of one length are many, and every piece has one place."""
    rows = [(i, None) for i in range(4000)] + [(4000 + i, "word " * (i % 700 + 1)) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=512).collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 512 and len(ends) == -(-sum(r.length for r in got) // 512)
    assert Counter(r.doc_id for r in got if r.doc_id < 4000) == Counter(range(4000))


def test_preferences_brute_force(spark):
    """Pairs, prefixes, renderings and masks of many conversations, computed again in plain Python: a hot opening, equal
    conversations, repeated turns, a null conversation, extra columns with clashing names."""
    rng = random.Random(15)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "hot" if t == 0 and c % 3 else rng.choice("abc")) for c in range(60) for t in range(rng.randrange(1, 5))]
    rows += [(None, 0, "user", "hot"), (None, 0, "user", "again"), (None, 1, "assistant", None), (7, 0, "user", "hot")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, rank int, opening int").repartition(3)
    talks = {}
    for c, t, role, text in rows:
        talks.setdefault(c, []).append((t, role or "", text or ""))
    talks = {c: [x[1:] for x in sorted(ts)] for c, ts in talks.items()}
    content = lambda c: "".join(f"{r}\x1f{x}\x1e" for r, x in talks[c])
    groups = {}
    for c in talks:
        groups.setdefault(talks[c][0], []).append(c)
    shown = lambda ts: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in ts)

    def mask(ts):
        out, at = [], 0
        for r, x in ts:
            at += len(r) + 5
            if r == "assistant":
                out.append(f"{at}-{at + len(x) + 8}")
            at += len(x) + 8
        return ",".join(out)

    order = lambda c: (content(c), c is not None, c or 0)
    want = set()
    for members in groups.values():
        members.sort(key=order)
        for i in range(0, len(members), 2):
            pair = sorted(members[i : i + 2], key=lambda c: (-sum(len(x) for r, x in talks[c] if r == "assistant"), c is not None, c or 0))
            a, b = talks[pair[0]], talks[pair[1]] if len(pair) > 1 else None
            k = 1 if b is None else next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            want.add((pair[0], pair[1] if b is not None else None, k, shown(a[:k]), shown(a[k:]), None if b is None else shown(b[k:]), mask(a[k:]), None if b is None else mask(b[k:])))
    assert {tuple(r) for r in preferences.preference_pairs(df).collect()} == want


def test_scratch_is_released(spark):
    from foliant.llm import common

    assert common.materialise(spark.range(5), "x").count() == 5
    common.release(spark)
    assert common.materialise(spark.range(3), "x").count() == 3
