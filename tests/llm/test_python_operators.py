import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathom.llm import bpe, langid, packing, sharding, simhash, topk
from fathom.llm.common import written
from fathom.llm.components import components


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_tree_concatenation_equals_the_library(library):
    enc = bpe.Encoder(bpe.default_path(), memo=500, run=16)
    rng = random.Random(3)
    kinds = ["abcdefgh etaoinshr", "aaab", "thein", "Éèà'sd tr", "....--'s!", "漢字かな", "0123 abc²Ⅷ", "éa n", "각ᅡᆨ가x", "<|endoftext|>a", "İΣσς A", "  \x1c\x85 a\n", "🙂👍🏽a"]
    for _ in range(1500):
        text = "".join(rng.choice(k) for k in [rng.choice(kinds)] for _ in range(rng.randint(0, 150)))
        text += "<|endoftext|>" * (rng.random() < 0.1)
        want = ids_of(library, text)
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == want
        leaves = list(enc.leaves(text, rng.choice([3, 8, 20, 40])))
        assert "".join(x for x, _ in leaves) == text
        assert enc.tree([enc.leaf(x, h) for x, h in leaves], [h for _, h in leaves][:-1]) == want


@pytest.mark.parametrize("slots, bits, memo", [(8, 64, 10_000), (1 << 20, 5, 10_000), (1 << 20, 64, 3)])
def test_memo_does_not_change_ids(library, monkeypatch, slots, bits, memo):
    """Few slots, hashes that collide, and a memo that is forgotten again and again."""
    real = bpe.hashes
    monkeypatch.setattr(bpe, "SLOTS", slots)
    monkeypatch.setattr(bpe, "hashes", lambda *a: real(*a) & np.uint64(2**bits - 1))
    monkeypatch.setattr(bpe, "BUFFER", 60)
    enc, rng = bpe.Encoder(bpe.default_path(), memo=memo), random.Random(5)
    texts = [" ".join(rng.choice(["The", "the", "THE,", "don't", "Éa-7", "x12", "\t漢字", "internationalisation", "<|endoftext|>"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [ids_of(library, t) for t in texts]
    assert enc.joins  # words of more than RUN characters are put together from halves


def test_encode_and_decode_whole_texts(docs, rows, empty, library):
    out = bpe.encode(docs, keep=("doc_id", "text"), decoded="back", leaf=1000).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    for r in out:
        want = ids_of(library, r.text)
        assert r.ids == want and r.back == library.decode(want, skip_special_tokens=False)
    some = bpe.decode(bpe.encode(docs.where("doc_id < 5")), name="z").first()
    assert some.z == library.decode(some.ids, skip_special_tokens=False)
    assert bpe.encode(empty).count() == 0


def test_plan_is_tight_and_whole():
    rng = random.Random(1)
    for capacity in (1, 7, 64):
        for _ in range(60):
            counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))}
            used, ranks = defaultdict(list), defaultdict(list)
            for s in packing.plan(counts, capacity):
                for k in range(s.end_rank - s.first_rank):
                    at = s.offset + (k % s.each) * s.length
                    used[s.first_sequence + k // s.each].append((at, at + s.length))
                    ranks[s.length].append(s.first_rank + k)
            assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
            for spans in used.values():
                spans.sort()
                assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= capacity
            room = []  # best-fit decreasing, piece by piece
            for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
                fits = [r for r in room if r >= n]
                if fits:
                    room.remove(min(fits))
                    room.append(min(fits) - n)
                else:
                    room.append(capacity - n)
            assert len(used) == len(room)


def test_packing_documents(docs, rows, empty, library):
    out = packing.packed_documents(docs, capacity=256).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    want = Counter()
    for d, text, *_ in rows:
        ids = [*ids_of(library, text), packing.END]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[d, k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert got == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 256
    assert len(by) <= 1.02 * sum(r.length for r in out) / 256 + 1
    cut = written(packing.pieces(docs.where("doc_id < 8"), 256), "p")
    whole = packing.assemble(packing.pack(cut, 256)).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole)
    assert packing.packed_documents(empty).count() == 0


def labels_of(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(25)] + [(7, 7)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(frame).collect()}
    want = labels_of(edges, {x for e in edges for x in e})
    assert {n: got.get(n, n) for n in want} == want
    assert components(frame.limit(0)).count() == 0


def fingerprint(text):
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    k = min(4, len(found))
    h = [xxhash.xxh64_intdigest(b" ".join(found[i : i + k]), 42) for i in range(len(found) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(docs, rows, empty):
    out = simhash.classes(docs).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in out) == Counter((d, fingerprint(t)) for d, t, *_ in rows)
    fps = {r.fp & (2**64 - 1) for r in out}
    label = labels_of([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4], fps)
    least = defaultdict(list)
    for r in out:
        if r.doc_id is not None:
            least[label[r.fp & (2**64 - 1)]].append(r.doc_id)
    assert all(r.component_id == min(least[label[r.fp & (2**64 - 1)]], default=None) for r in out)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label.values()))
    assert simhash.classes(empty).count() == simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_simhash_links_lose_nothing(spark, block):
    rng = random.Random(block)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for x in list(fps)[:100]:
        for _ in range(3):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    frame = written(spark.createDataFrame([(x,) for x in signed], "fp long"), "fps")
    edges = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.links(frame, block=block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    assert labels_of(edges, fps) == labels_of([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4], fps)


def test_language_of_held_out_texts(docs, empty):
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    assert model.langs == ["en", "fr"]
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    truth = docs.where("doc_id < 40").select("doc_id", "lang", langid.held_out(F.col("doc_id")).alias("h")).collect()
    assert any(r.h for r in truth) and all(out[r.doc_id].lang_pred == r.lang and 0.9 < out[r.doc_id].score <= 1 for r in truth)
    assert all((out[d].lang_pred, out[d].score) == ("und", 0.0) for d in (110, 111, 112, 113))
    kept = langid.known_language(docs, model)
    assert kept.columns == docs.columns and not {110, 111, 112, 113} & {r.doc_id for r in kept.collect()}
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def plain_words(text):
    """Runs of letters in lower case, 256 at most."""
    out = []
    for run in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        out += [run[i : i + langid.RUN] for i in range(0, len(run), langid.RUN)]
    return out


def plain_scores(learned, texts, longest=4):
    """(language, score) of each text, by dictionaries of counted words and n-grams."""
    langs = sorted({g for g, _ in learned})
    counts = {g: Counter() for g in langs}
    grams = lambda w, k: [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)]
    for g, t in learned:
        for w in plain_words(t):
            counts[g][0, w] += 1
            counts[g].update((k, x) for k in range(1, longest + 1) for x in grams(w, k))
    totals = {(g, k): max(1, sum(n for (j, _), n in counts[g].items() if j == k)) for g in langs for k in range(longest + 1)}

    def logs(key):
        share = [counts[g][key] / totals[g, key[0]] for g in langs]
        return [math.log(s or min(0.1 * max(share), 0.5 / totals[g, key[0]])) for s, g in zip(share, langs)] if any(share) else None

    def vector(w):
        if v := logs((0, w)):
            return v
        for k in range(longest, 0, -1):
            if found := [v for x in grams(w, k) if (v := logs((k, x)))]:
                return [sum(c) / len(found) for c in zip(*found)]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        vs = [vector(w) for w in plain_words(t)]
        total = [sum(c) for c in zip(*vs)]
        p = [math.exp(x - max(total)) for x in total]
        out.append((langs[p.index(max(p))], max(p) / sum(p)) if vs else ("und", 0.0))
    return out


def test_language_equals_a_plain_scorer(docs, rows, monkeypatch):
    """On every text, known and unseen words, long runs of letters and texts above the size worked on at a time."""
    odd = ["zqx lumièr wit", "ab" * 700 + "zq", "the" + "\x00" + "Maison ΑΣ", "İstanbul ǅ ß", "中文" * 300, "x", "the " * 3000, "9 9"]
    learned = [(g, t) for d, t, g, _ in rows if d is not None and g and t is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    texts = [t for _, t, *_ in rows] + odd
    for part in (langid.PART, 1024):
        monkeypatch.setattr(langid, "PART", part)
        best, score = langid.predictions(model, texts, len(texts))
        got = [(model.langs[b] if b >= 0 else "und", s) for b, s in zip(best, score)]
        for (a, x), (b, y) in zip(got, plain_scores(learned, texts)):
            assert x == pytest.approx(y, abs=1e-3) and (a == b or abs(x - 0.5) < 1e-3)


def test_language_training_is_bounded_by_rows_and_characters(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 20, "en") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every = len(langid.train(frame).keys)
    assert len(langid.train(frame, sample=60).keys) < every / 3 and len(langid.train(frame, chars=10_000).keys) < every / 3


def brute(rows, k=10):
    data = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        data.setdefault((i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)), None)
    out = []
    for i, q in data:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in data if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("n, block", [(400, 64), (400, 8192), (6, 8192), (0, 8192)])
def test_top_k_equals_brute_force(spark, n, block):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=12) + 3 * (i % 4)]) for i in range(n)]
    if n > 6:
        rows += [(1000 + i, rows[7][1]) for i in range(40)] + [rows[3]]  # one very common vector, a repeated row
        rows += [(2000, None), (2010, [1.0, None] * 6), (2020, [float("nan")] * 12), (2030, [float("inf")] * 12), (None, rows[0][1]), (2040, [])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, v int, region int")
    got = topk.search(frame, frame.where("vec_id % 10 = 0"), 10, block=block, seeds=50, regions=5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_hilbert_curve_is_a_path_over_all_cells():
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        place = sharding.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_sharding(docs, rows, empty):
    out = sharding.shard(written(sharding.measured(docs), "m")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    ends = [(min(r.curve for r in s), max(r.curve for r in s)) for _, s in sorted(by.items())]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    few = sharding.shard(written(sharding.measured(docs.where("doc_id < 3")), "m")).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shard(written(sharding.measured(empty), "m")).count() == 0
    own = written(sharding.measured(docs.withColumns({c: F.lit("mine") for c in ("part", "g", "curve", "dim_0", "group_0")}), keep=("lang", "source", "part", "g", "curve", "dim_0", "group_0")), "m")
    clash = sharding.shard(own).collect()
    assert {(r.part, r.g, r.curve, r.dim_0, r.group_0) for r in clash} == {("mine",) * 5} and Counter((r.doc_id, r.shard) for r in clash) == Counter((r.doc_id, r.shard) for r in out)


def test_equal_texts_are_neighbours(spark):
    """Whatever their metadata: a group lies in as few shards as its slots allow."""
    rows = [(i, f"text {i % 37}", f"l{i % 5}", f"s{i % 11}") for i in range(800)]
    out = sharding.shard(written(sharding.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "m")).collect()
    at = {r.doc_id: r.shard * 100 + r.slot for r in out}
    for k in range(37):
        places = sorted(at[i] for i in range(k, 800, 37))
        assert places == list(range(places[0], places[0] + len(places)))
