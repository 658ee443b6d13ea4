"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows in every table."""

import base64
import gzip
import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.llm import components, decontaminate, jaccard_join, language_id, pieces, quality, sharding, substring_dedup, token_counts, token_store, warc
from tideway.llm.common import fresh_dir, tokenizer_path, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, id long, row string, kept string"


def made() -> list[tuple[int | None, str | None]]:
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeÉßñ.,!"), int(rng.integers(1, 7))))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(30)
    out: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three four five"), (7, base), (8, base), (9, base.upper().lower())]
    for k in range(10, 22):  # near copies at all distances
        ws = base.split(" ")
        for j in rng.choice(len(ws), k - 9, replace=False):
            ws[j] = word()
        out.append((k, " ".join(ws)))
    for k in range(22, 30):
        out.append((k, text(40) + "\n" + passage + "\n" + text(int(rng.integers(0, 60)))))
    out += [(30, "x " * 5000), (31, text(6000)), (32, "a" * 9000), (33, "<|endoftext|> it's  ▁ a b c \x0bd"), (40, passage), (40, passage), (None, base), (None, passage), (-5, text(20) + " " + passage)]
    return out


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 7, 8, "r", "k") for i, t in rows], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_row(df, key="doc_id"):
    return Counter(tuple(r) for r in df.collect())


def shingles(t):
    ws = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def expected_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else top(i)) for i, s in sets)


def test_jaccard_join(docs, rows, none):
    assert by_row(jaccard_join.jaccard_components(docs)) == expected_components(rows)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_join_heavy_shingles(spark, monkeypatch):
    """A passage in every document is heavy and goes last in the order; near copies around it are still linked."""
    monkeypatch.setattr(jaccard_join, "HEAVY", 4)
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = []
    for g in range(20):
        own = [f"w{g}x{k}" for k in range(60)]
        for c in range(6):
            ws = list(own)
            for j in rng.choice(60, int(rng.integers(0, 4)), replace=False):
                ws[j] = f"new{g}{c}{j}"
            rows.append((g * 10 + c, " ".join(ws[:20]) + " " + passage + " " + " ".join(ws[20:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert by_row(jaccard_join.jaccard_components(df)) == expected_components(rows)


def test_jaccard_join_of_near_copies_around_the_limit(spark, monkeypatch):
    """Near copies of one text, most pairs of which lie just under or over 0.8, in many blocks; sizes differ as well."""
    monkeypatch.setattr(jaccard_join, "MEMBERS", 8)
    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        ws = [f"w{k}" for k in range(int(rng.integers(90, 130)))]
        for j in rng.choice(len(ws), int(rng.integers(0, 4)), replace=False):
            ws[j] = f"new{i}x{j}"
        rows.append((i, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    expected = expected_components(rows)
    assert 1 < len({c for _, _, c in expected}) < 120
    assert by_row(jaccard_join.jaccard_components(df)) == expected


def test_jaccard_join_inside_one_group(spark):
    """B and C of a group (same prefix and size) are alike, but neither is like the group's leader A; sometimes D has a part of them."""
    rows, same = [], 0
    for g in range(60):
        ws = [f"g{g}w{k}" for k in range(13)]
        b, c = [*ws[:11], f"x{g}", f"y{g}"], [*ws[:11], f"x{g}", f"z{g}"]
        rows += [(10 * g, " ".join(ws)), (10 * g + 1, " ".join(b)), (10 * g + 2, " ".join(c))]
        same += len({tuple(jaccard_join.shingle_sets([t.encode()], 5)[0][:2]) for _, t in rows[-3:]}) == 1
        if g % 2:
            rows.append((10 * g + 3, " ".join([*ws[g % 7 : g % 7 + 5], *(f"d{g}v{k}" for k in range(8))])))
    assert same > 9
    expected = expected_components(rows)
    assert (1, 9, 1) in expected and (2, 9, 1) in expected
    assert by_row(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))) == expected


def test_components_of_a_chain_and_a_star(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(100, 160).select(F.lit(99).cast("long").alias("a"), F.col("id").alias("b")))
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 99 for k in range(99, 160)}


def test_ring_sharding(docs, rows, none):
    found = sharding.shard_by_ring(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_by_ring(none).count() == 0


def test_ring_sharding_moves_little(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    place = lambda n: {r.doc_id: r.shard for r in sharding.shard_by_ring(df, shards=n, slack=0.25).collect()}
    a, b = place(8), place(9)
    assert max(Counter(a.values()).values()) <= 3000 * 1.25 / 8 + 1
    assert sum(a[k] != b[k] for k in a) < 3000 * 0.35


def test_token_counts(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(BPE))
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in rows)
    assert by_row(token_counts.token_counts(docs, tokenizer_path(BPE))) == want
    assert token_counts.token_counts(none, tokenizer_path(BPE)).count() == 0


def test_other_tokenizer_is_encoded_whole(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    found = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json")).collect())
    assert found == Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)


def test_word_table_on_random_text():
    rng = np.random.default_rng(5)
    letters = [*"abcXYZ'  \n\t!<|>éßİΣςΆ日9٣½ªº×÷", "̈", " ", "\x85", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "***", "\x0b\x0c"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 30)))) for _ in range(3000)]
    table = token_counts.WordTable(tokenizer_path(BPE))
    for x, got in zip(texts, table.packed([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, table.type).tolist() == table.tokenizer.encode(x, add_special_tokens=False).ids, x


def test_plain_parts_are_encoded_by_the_model_alone(monkeypatch):
    """The whole tokenizer's normaliser and expressions took a third of the time of words that are cut already."""
    rng = np.random.default_rng(8)
    letters = [*"abcXYZ  \n\t!|éßÖñ93#$%*.,", "ing", "\x0b\x0c"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(2000)]
    table = token_counts.WordTable(tokenizer_path(BPE))
    whole = table.tokenizer
    monkeypatch.setattr(token_counts, "TABLE_WORDS", 300)
    table.tokenizer = None
    got = [x for k in range(0, len(texts), 100) for x in table.packed([t.encode() for t in texts[k : k + 100]])]
    for x, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, table.type).tolist() == whole.encode(x, add_special_tokens=False).ids, x
    assert len(table.parts) < 3000
    table.by_part, parts = None, table.by_part
    with pytest.raises(AttributeError):
        list(table.packed([b"unheardof words"]))
    table.by_part = parts
    assert np.frombuffer(next(table.packed([b"unheardof words"])), table.type).tolist() == whole.encode("unheardof words", add_special_tokens=False).ids


def test_chunks_end_where_the_hash_of_the_last_ids_says():
    rng = np.random.default_rng(9)
    for n in (1, 63, 64, 65, 1025, 5000, 20000):
        ids = rng.integers(0, 60 if n == 5000 else 49408, n).astype(np.uint16)
        mixed = [(int(x) + 1) * int(token_store.MIX) % 2**64 for x in ids]
        mixed = [x ^ x >> 29 for x in mixed]
        want, at = [], 0
        for end in range(1, n + 1):
            rolled = 0
            for x in mixed[max(0, end - token_store.SPAN) : end]:
                rolled = (rolled * 0x100000001B3 + x) % 2**64
            marked = end - at >= token_store.MIN_IDS and not (rolled ^ rolled >> 31) & int(token_store.MASK)
            if marked or end - at == token_store.MAX_IDS or end == n:
                want.append(end)
                at = end
        assert token_store.cuts(ids) == want


def test_sentencepiece(docs, rows, none):
    known = pieces.chunk_table(tokenizer_path(PIECES))
    assert known.apart
    want = Counter()
    for i, x in rows:
        ids = known.model.encode(x or "")
        want[(i, len(ids), tuple(ids), known.model.decode(ids))] += 1
    found = pieces.encode_pieces(docs, tokenizer_path(PIECES)).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in found) == want
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert by_row(pieces.encode_pieces(docs, tokenizer_path(PIECES), digests=True)) == Counter({(i, n, digest(",".join(map(str, ids))), digest(d)): c for (i, n, ids, d), c in want.items()})
    assert pieces.encode_pieces(none, tokenizer_path(PIECES)).count() == 0


def test_sentencepiece_blanks():
    known = pieces.chunk_table(tokenizer_path(PIECES))
    texts = ["", " ", "  ", "   ", "▁", "▁ ", " ▁", "a  b", "a ", "  a", "a\nb \n c"]
    for x, got in zip(texts, known.run([t.encode() for t in texts]), strict=True):
        ids = known.model.encode(x)
        assert got == (",".join(map(str, ids)), len(ids), known.model.decode(ids)), x


def test_substring_dedup(docs, rows, none):
    found = Counter(tuple(r) for r in substring_dedup.substring_dedup(docs, digests=True).collect())
    first: dict = {}
    for i, t in rows:
        ws = WORDS.findall(t or "")
        for k in range(len(ws) - 12):
            key = tuple(ws[k : k + 13])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t in rows:
        ws = WORDS.findall(t or "")
        gone = set()
        for k in range(len(ws) - 12):
            if i is not None and first[tuple(ws[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        left = [w for k, w in enumerate(ws) if k not in gone]
        want[(i, len(ws), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())] += 1
    assert found == want
    assert substring_dedup.substring_dedup(none).count() == 0
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect() if r.doc_id is not None}
    assert texts[1] is None and texts[8] == "" and texts[7] == dict(rows)[7]


@pytest.mark.parametrize("limits", [{}, {"HOT_ANCHOR": 20}, {"HOT": 1, "HOT_WORDS": 300}, {"SHARD_WORDS": 30}, {"BATCH_BYTES": 2000, "HOT_ANCHOR": 60, "SHARD_WORDS": 50, "COPIES": 2}])
def test_substring_dedup_by_every_way(spark, monkeypatch, limits):
    """Common lines between other words, copies, passages inside others, and repeats inside one document, with limits
    that send them by each of the ways: broadcast shard, other shards, hot anchors, windows one by one."""
    for name, value in limits.items():
        monkeypatch.setattr(substring_dedup, name, value)
    rng = np.random.default_rng(12)
    word = lambda: f"w{int(rng.integers(0, 400))}"
    line, passage = [f"l{k}" for k in range(7)], [f"p{k}" for k in range(60)]
    rows = []
    for i in range(60):
        ws: list[str] = []
        for _ in range(int(rng.integers(1, 6))):
            kind = int(rng.integers(0, 5))
            a = int(rng.integers(0, 40))
            ws += line if kind == 0 else passage[a : a + int(rng.integers(5, 40))] if kind == 1 else ["x"] * int(rng.integers(1, 30)) if kind == 2 else [word() for _ in range(int(rng.integers(1, 20)))]
        rows.append((int(rng.integers(0, 50)), " ".join(ws)))
    rows += [(100 + k, rows[k % 3][1]) for k in range(9)]
    first: dict = {}
    for i, t in rows:
        ws = t.split()
        for k in range(len(ws) - 12):
            key = tuple(ws[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t in rows:
        ws = t.split()
        gone = {j for k in range(len(ws) - 12) if first[tuple(ws[k : k + 13])] < i for j in range(k, k + 13)}
        want[(i, len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest())] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in substring_dedup.substring_dedup(df, digests=True).collect()) == want


def test_automaton_finds_every_window():
    rng = np.random.default_rng(4)
    texts = [(rng.integers(0, 4, int(rng.integers(3, 60))).tolist(), int(i)) for i in rng.permutation(40)]
    known = substring_dedup.Automaton(iter(texts))
    least: dict = {}
    for ws, i in texts:
        for k in range(len(ws) - 5):
            least[tuple(ws[k : k + 6])] = min(least.get(tuple(ws[k : k + 6]), i), i)
    for ws, i in [*texts, (rng.integers(0, 4, 300).tolist(), 20)]:
        hits = [k for k in range(len(ws) - 5) if least.get(tuple(ws[k : k + 6]), i) < i]
        spans, count = known.spans(ws, i, 6)
        assert count == len(hits) and {j for a, e in spans for j in range(a, e)} == {j for k in hits for j in range(k, k + 6)}


def test_decontamination(spark, docs, none):
    rng = np.random.default_rng(1)
    item = " ".join(f"q{k}" for k in range(30))
    swapped = " ".join("zz" if k % 9 == 4 else f"Q{k}," for k in range(30))  # a ninth of the words replaced
    other = " ".join(f"r{k}" for k in rng.permutation(80))
    text = [(1, other + " " + item + " tail"), (2, swapped + " " + other), (3, other), (4, " ".join(f"q{k}" for k in range(12))), (5, None), (None, item), (1, other + " " + item + " tail")]
    bench = spark.createDataFrame([(70, item, "x"), (71, None, "x"), (72, "short item", "x"), (70, item, "x")], "item_id long, text string, words string")
    found = decontaminate.contaminated(spark.createDataFrame(text, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 70), (2, 70), (None, 70)} and len(found) == 3
    assert {r.doc_id: r.start for r in found}[1] == 80 and {r.doc_id: r.n_equal for r in found}[1] == 30
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def allowed(m):
    return m - -(-m * decontaminate.AGREE // decontaminate.WINDOW)


def test_decontamination_masks_miss_no_alignment():
    """All patterns of words that may differ, in runs of 1 to 16 words, leave a mask whole."""
    for m in range(1, decontaminate.WINDOW + 1):
        masks = next(masks for n, masks in decontaminate.BANDS if n <= m)
        spots = [{at + j for j, c in enumerate(x) if c == "1"} for x in masks for at in range(m - len(x) + 1)]
        for gone in itertools.combinations(range(m), allowed(m)):
            assert any(s.isdisjoint(gone) for s in spots), (m, gone)
    every = [x for _, masks in decontaminate.BANDS for x in masks]
    assert len(set(every)) == len(every) and all(x[0] == "1" for x in every)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination_of_altered_and_short_items(spark, monkeypatch, broadcast):
    """Against brute force, with the seeds broadcast and with seeds too many for it."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(6)
    items = {m * 10 + k: [f"i{m}x{k}w{j}" for j in range(m)] for m in [*range(1, 18), 24] for k in range(2)}
    texts = []
    for i, ws in items.items():
        window = min(len(ws), decontaminate.WINDOW)
        for much in range(allowed(window) + 2):
            for gone in [rng.choice(window, min(much, window), replace=False) for _ in range(3)] + [np.array([0, 2, 13][:much])]:
                copy = [f"z{len(texts)}" if j in gone else w for j, w in enumerate(ws)]
                texts.append([f"a{len(texts)}"] * int(rng.integers(0, 3)) + copy + [f"b{len(texts)}"] * int(rng.integers(0, 3)))
    texts.append(items[50][:4])  # an item's part, and two texts of one id
    words = [(k // 2 if k < 20 else k, ws) for k, ws in enumerate(texts)]
    want: dict = {}
    for d, ws in words:
        for i, item in items.items():
            window = min(len(item), decontaminate.WINDOW)
            for shift in range(-len(item), len(ws)):
                low = max(-shift, 0)
                equal = [ws[j + shift] == item[j] for j in range(low, min(len(item), len(ws) - shift))]
                if any(sum(equal[k : k + window]) * decontaminate.WINDOW >= window * decontaminate.AGREE for k in range(len(equal) - window + 1)):
                    want[d, i] = max(want.get((d, i), (0, 0)), (sum(equal), -low - shift))
    docs = spark.createDataFrame([(d, " ".join(ws)) for d, ws in words], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id): (r.n_equal, -r.start) for r in decontaminate.contaminated(docs, bench).collect()} == want
    assert {i for _, i in want} == set(items)


def test_decontamination_of_long_texts(spark):
    item = [f"q{k}" for k in range(20)]
    long = [f"w{k % 977}" for k in range(60_000)]
    rows = [(1, " ".join(long[:40_000] + item + long[40_000:])), (2, " ".join(long)), (3, "x" * 200_000)]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start, r.n_equal) for r in found] == [(1, 7, 40_000, 20)]


def test_quality_features(docs, rows, none):
    want = Counter()
    for i, t in rows:
        ws, lines = WORDS.findall(t or ""), [x for x in (t or "").split("\n") if WORDS.search(x)]
        triples = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        covered = {j for k in range(len(ws) - 2) if triples[tuple(ws[k : k + 3])] > 1 for j in range(k, k + 3)}
        n = len(ws)
        want[(i, n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)] += 1
    found = quality.quality_rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in found) == want
    assert all(not r.kept for r in found if r.base_failed) and any(r.kept for r in found)
    assert quality.quality_rules(none).count() == 0
    assert quality.good_rows(docs).columns == docs.columns


def plain_em(patterns, rounds):
    """The same estimate in plain Python: {pattern: whether its documents are kept}."""
    names = list(quality.votes())
    start = {p: (0.95, 0.3, 0.05)[min(2, sum(v == -1 for v in p))] for p in patterns}
    post, chance = start, {(k, v, good): {-1: (0.4, 0.01), 0: (0.2, 0.1), 1: (0.4, 0.89)}[v][good] for k in range(len(names)) for v in (-1, 0, 1) for good in (0, 1)}
    prior = 0.9
    for _ in range(rounds):
        mass = [sum(n * (1 - post[p]) for p, n in patterns.items()), sum(n * post[p] for p, n in patterns.items())]
        prior = min(max((mass[1] + 0.1) / (sum(mass) + 0.2), 0.05), 0.99)
        new = {}
        for k, v, good in chance:
            seen = sum(n * (post[p] if good else 1 - post[p]) for p, n in patterns.items() if p[k] == v)
            new[k, v, good] = (seen + 0.1) / (mass[good] + 0.3)
        moved = max(abs(new[x] - chance[x]) for x in new)
        chance = new
        odds = {p: math.log(prior / (1 - prior)) + sum(math.log(chance[k, v, 1] / chance[k, v, 0]) for k, v in enumerate(p)) for p in patterns}
        post = {p: 1 / (1 + math.exp(-min(max(x, -40), 40))) for p, x in odds.items()}
        if moved < 1e-4:
            break
    return {p: odds[p] >= 0 for p in patterns}, post


def test_quality_estimates_like_a_plain_em(spark):
    found = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    names = list(quality.votes())
    judged = [r for r in found if not r.base_failed]
    kept, post = plain_em(Counter(tuple(r[n] for n in names) for r in judged), quality.ROUNDS)
    assert all(r.kept == kept[tuple(r[n] for n in names)] and abs(r.quality - post[tuple(r[n] for n in names)]) < 1e-6 for r in judged)
    both = [n for n in names if {-1, 1} <= {r[n] for r in judged}]
    assert len(both) >= 5, both


def test_quality_against_labels(spark):
    """Better than keeping everything, which is right for the share of good labels."""
    big = "/root/testdata/sf0.1"
    found = quality.op7_quality_rules(spark, big).filter("not base_failed").join(spark.read.parquet(f"{big}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").collect()
    majority = np.mean([r.label == 1 for r in found])
    assert majority < 0.93 and np.mean([r.kept == (r.label == 1) for r in found]) > 0.99
    assert np.mean([r.kept for r in found if r.label == 1]) > 0.99


def test_language_id(spark, docs, none):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(df, tokenizer_path(PIECES), per_language=100).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert {r.lang_pred for r in language_id.identify(docs, tokenizer_path(PIECES)).collect()} == {"und"}  # nothing to learn from
    assert language_id.identify(none, tokenizer_path(PIECES)).count() == 0


def test_language_needs_a_letter(spark):
    learned = spark.createDataFrame([(k, "der hund und die katze" if k % 2 else "the dog and the cat", "de" if k % 2 else "en") for k in range(40)], "doc_id long, text string, lang string")
    odd = ["½ ²", "①", "12 3", "_", "Ⅷ", "٣", "a½", "ª"]
    model = language_id.fit(learned, tokenizer_path(PIECES))
    assert [x for x, _ in model.texts(odd)][:6] == ["und"] * 6 and "und" not in [x for x, _ in model.texts(odd)][6:]
    assert language_id.words_of("a½b Ⅷc١") == ["a", "b", "c"]


def test_language_forward_sums_all_segmentations():
    model = language_id.LanguageModel(["?", "▁", "a", "b", "ab", "▁a"], ["x"], np.array([[1e-9], [0.3], [0.2], [0.1], [0.25], [0.15]]))
    p = dict(zip(model.pieces, model.p[:, 0], strict=True))
    want = p["▁"] * p["a"] * p["b"] + p["▁"] * p["ab"] + p["▁a"] * p["b"]
    assert np.exp(model.scores(["ab"]))[0, 0] == pytest.approx(want, rel=1e-6)


def test_warc(spark, rows):
    pages = [(i, f"http://x.example/{i} b" if t else None, t) for i, t in rows if i != 40] + [(50, "u", "same"), (51, None, "same"), (50, "u", "same"), (-1, "v", "as minus one"), (None, "v", "as minus one"), (None, "w", "nobody's"), (None, "w", "nobody's")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(2)
    found = Counter(tuple(r) for r in warc.read_pages(warc.write_pages(df, fresh_dir(spark, "warc"))).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    least: dict = {}
    for i, _, t in pages:
        if i is not None:
            least[digest(t)] = min(least.get(digest(t), i), i)
    want = Counter()
    for i, _, t in pages:
        f = least.get(digest(t), i)
        want[(i, len((t or "").encode()), digest(t), "response" if f == i else "revisit", None if f == i else f)] += 1
    assert found == want
    assert warc.read_pages(warc.write_pages(df.limit(0), fresh_dir(spark, "warc"))).count() == 0


def test_arc_versions(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\nX-Page-Id: 9\r\n\r\nhello\n\nworld"
    for version in (1, 2):
        records = [({"url": "http://a.example/x y", "ip": "1.2.3.4", "date": "19970102030405", "type": "text/html", "result": "200"}, body), ({"url": "dns:a", "ip": "-", "date": "1998", "type": "text/dns"}, b"")]
        arc = warc.write_arc(records, version, "old.arc", "19960923142103")
        found = list(warc.read_arc(arc))
        assert [r.version for r in found] == [version] * 3 and found[1].body == body and found[1].fields["url"] == "http://a.example/x y"
        made = warc.to_warc(found[1]).decode()
        assert "WARC-Date: 1997-01-02T03:04:05Z" in made and "WARC-Type: response" in made and warc.sha1(b"hello\n\nworld") in made
        assert "WARC-Type: resource" in warc.to_warc(found[2]).decode() and "WARC-Date: 1998-01-01T00:00:00Z" in warc.to_warc(found[2]).decode()
        assert "WARC-Type: warcinfo" in warc.to_warc(found[0]).decode()
        zipped = b"".join(gzip.compress(arc[a:e]) for a, e in ((0, 40), (40, 90), (90, len(arc))))
        assert list(warc.read_arc(zipped)) == found
        with pytest.raises(ValueError):
            list(warc.read_arc(zipped[:-9]))
        for bad in (arc[:-30], b"no archive\n", arc.replace(b" %d\n" % len(body), b" 4x\n")):
            with pytest.raises(ValueError):
                list(warc.read_arc(bad))
    (tmp_path / "old.arc").write_bytes(arc)
    files = spark.read.format("binaryFile").load(str(tmp_path / "old.arc"))
    assert [r.page_id for r in warc.read_pages(warc.convert_arcs(files, fresh_dir(spark, "warc"))).collect()] == [9]


def test_token_store(spark, docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(BPE))
    manifest = token_store.write_store(docs, tokenizer_path(BPE), fresh_dir(spark, "store"))
    streams = [(i, (*t.encode(x or "", add_special_tokens=False).ids, 1)) for i, x in rows]
    assert Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_documents(manifest).collect()) == Counter(streams)
    at, want = 0, {}
    for i, ids in sorted((s for s in streams if s[0] is not None), key=lambda s: s[0]):
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    found = sorted(token_store.read_summary(manifest).collect(), key=lambda r: r.start)
    for r in found:
        assert r.start == at and (r.doc_id is None or (r.n_tokens, r.ids_crc32) == want[r.doc_id])
        at += r.n_tokens
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == len(rows)
    stored = token_store.read_chunks(manifest)
    assert stored.count() == stored.select("address").distinct().count()
    assert token_store.read_summary(token_store.write_store(none, tokenizer_path(BPE), fresh_dir(spark, "store"))).count() == 0


def test_token_store_finds_damage(spark, docs):
    manifest = token_store.write_store(docs, tokenizer_path(BPE), fresh_dir(spark, "store"))
    uri = manifest.filter("kind = 0").first()["uri"].removeprefix("file:")
    uri = "/" + uri.lstrip("/")
    raw = bytearray(open(uri, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(uri, "wb").write(bytes(raw))
    with pytest.raises(Exception):  # noqa: B017  a damaged block or a wrong digest
        token_store.read_summary(manifest).collect()


def test_pipeline(spark, sf_dir):
    """Each stage against a brute-force version of it on what its predecessor kept."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    every = read(docs)
    good = p.quality_rules(spark, docs, sf_dir)
    assert good.columns == docs.columns
    kept = read(good)
    judged = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert kept == {i: t for i, t in every.items() if judged[i]}
    single = read(p.near_duplicates(spark, good, sf_dir))
    assert set(single) == {i for i, _, c in expected_components(list(kept.items())) if i == c}
    source = good.filter(F.col("doc_id").isin(list(single)))
    apart_df = p.repeated_passages(spark, source, sf_dir)
    apart = {r.doc_id: (r.text, r.n_chars) for r in apart_df.collect()}
    first: dict = {}
    split = {i: WORDS.findall(t) for i, t in single.items()}
    for i, ws in split.items():
        for k in range(len(ws) - 12):
            key = tuple(ws[k : k + 13])
            first[key] = min(first.get(key, i), i)
    for i, ws in split.items():
        gone = {j for k in range(len(ws) - 12) if first[tuple(ws[k : k + 13])] < i for j in range(k, k + 13)}
        assert WORDS.findall(apart[i][0]) == [w for k, w in enumerate(ws) if k not in gone] and apart[i][1] == len(apart[i][0])
    bench = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text]

    def leaked(text):
        ws = re.findall(r"[^\W_]+", text.lower())
        places = defaultdict(list)
        for j, w in enumerate(ws):
            places[w].append(j)
        for item in bench:
            window = min(len(item), decontaminate.WINDOW)
            for shift in {j - k for k, w in enumerate(item) for j in places[w]}:
                low = max(-shift, 0)
                same = [ws[j + shift] == item[j] for j in range(low, min(len(item), len(ws) - shift))]
                if any(sum(same[k : k + window]) * decontaminate.WINDOW >= window * decontaminate.AGREE for k in range(len(same) - window + 1)):
                    return True
        return False

    clean = read(p.benchmark_passages(spark, apart_df, sf_dir))
    assert clean == {i: t for i, (t, _) in apart.items() if not leaked(t)} and 0 < len(clean) < len(apart)
    last = p.run(spark, sf_dir)
    known = pieces.chunk_table(tokenizer_path(PIECES)).model
    assert last.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in last.collect()} == {i: (len(x := known.encode(t)), x, known.decode(x)) for i, t in clean.items()}


def test_pipeline_of_odd_tables(spark, sf_dir, docs, none):
    """Null ids and texts, repeated rows, extra columns, a missing n_chars, and empty tables pass through every stage."""
    import corpus_pipeline as p

    for rows in (docs, none, docs.drop("n_chars"), docs.select("doc_id", "text")):
        for name, stage in p.STAGES[:-1]:
            found = stage(spark, rows, sf_dir)
            assert found.columns == rows.columns, name
            assert found.count() <= rows.count()
        assert p.STAGES[-1][1](spark, rows, sf_dir).count() == rows.count()


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op5_substring_dedup", "op9_warc"])
def test_against_sql(name, spark, sf_dir):
    import oracle

    from tideway.llm import registry

    assert oracle.compare(spark, oracle.duck(sf_dir), sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


def test_ring_sharding_of_one_key(spark, monkeypatch):
    """A key of very many rows is numbered in steps and spread over shards."""
    monkeypatch.setattr(sharding, "STEP", 7)
    df = spark.range(300).select(F.when(F.col("id") < 200, 5).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    found = sharding.shard_by_ring(df, shards=4).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert len(found) == 300 and all(sorted(v) == list(range(75)) for v in slots.values()) and len(slots) == 4


def test_revisits_need_their_response(spark):
    manifest = warc.write_pages(spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string").coalesce(1), fresh_dir(spark, "warc"))
    assert {r.record_type for r in warc.read_pages(manifest).collect()} == {"response", "revisit"}
    uri = "/" + manifest.first()["uri"].removeprefix("file:").lstrip("/")
    members = []
    data = open(uri, "rb").read()
    while data:
        z = zlib.decompressobj(31)
        members.append(z.decompress(data))
        data = z.unused_data
    kept = [m for m in members if b"WARC-Type: response" not in m]
    open(uri, "wb").write(b"".join(warc.gzipped(m) for m in kept))
    with pytest.raises(ValueError, match="no response of page 1"):
        warc.read_pages(manifest.withColumn("records", F.lit(len(kept)).cast("long")))


def test_a_written_table_leaves_no_shuffle_behind(spark):
    """Shuffle files of finished steps add up to the disk that a job needs."""

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before = shuffles()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):  # files are removed in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left and len(table.collect()) == 7
