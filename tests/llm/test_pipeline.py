import random

from fathom.llm.common import written


def test_stages_keep_columns_and_clean_documents(spark, docs, empty):
    import corpus_pipeline as pipeline

    for table in (docs, empty):
        now = table
        for n, (_, stage) in enumerate(pipeline.STAGES, 1):
            now = written(stage(spark, now, ""), "stage")
            if n < len(pipeline.STAGES):
                assert now.columns == docs.columns
            if n == 1 and table is docs:
                assert {110, 111, 112, 113}.isdisjoint(r.doc_id for r in now.collect())
            if n == 3 and table is docs:
                kept = {r.doc_id for r in now.collect()}
                assert {0, 1, 2, 3, 39} <= kept and not {100, 101, 103} & kept
            if n == 4 and table is docs:
                assert "hunter2" not in "".join(r.text for r in now.collect())
        assert now.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (now.count() > 0) == (table is docs)


def test_near_duplicates_are_those_of_jaccard_similarity(spark, empty, tmp_path):
    import corpus_pipeline as pipeline

    from .conftest import words

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        base = words(rng, rng.choice([60, 200, 600]), vocabulary).split()
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.015, 0.02, 0.025, 0.04):
            texts.append(" ".join(rng.choice(vocabulary).upper() if rng.random() < share else w for w in base))
    common = words(rng, 12, vocabulary)
    texts += [f"{common} {words(rng, 30, vocabulary)}" for _ in range(30)] + ["one two", "ONE  two", "one three", "", None, " \n", "a b c d e", "a b c d e f"]
    texts += [f"{texts[0]} end{i}" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[7]), (None, "no id")]

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                root[top(i)] = top(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(top(i), []).append((d is None, d or 0))
    want = sorted(min(v) for v in best.values())
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    assert len(want) < len(rows) - 40
    assert pipeline.near_duplicates(spark, empty, "").count() == 0


def test_without_a_label_every_text_with_a_letter_stays(spark):
    import corpus_pipeline as pipeline

    rows = [(1, "a text", None), (2, "12 34", None), (3, None, None), (4, "", None), (5, "9 é", None)]
    out = pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert out.columns == ["doc_id", "text", "lang"] and sorted(r.doc_id for r in out.collect()) == [1, 5]


def test_exact_join_alone_finds_every_class(spark):
    from fathom.llm import neardup

    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    texts = []
    for n in (5, 9, 14, 40, 80):
        text = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(24):  # chains: each differs in a word or two from the one before it, or from the first
            text = list(text if rng.random() < 0.7 else texts[-1].split())
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
            texts.append(" ".join(text + ["tail"] * (rng.random() < 0.2)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                root[top(i)] = top(j)
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()
    assert len(got) == len(texts)
    mine = {r.id: r.root for r in got}
    pairs = {(top(i), mine[i]) for i in range(len(texts))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) < len(texts)


def test_line_dedup_makes_each_text_once(spark, docs):
    import corpus_pipeline as pipeline

    plan = pipeline.lines(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 1


def test_driver_garbage_goes_when_the_heap_is_past_half():
    from types import SimpleNamespace as Some

    from fathom.llm.common import tidy

    for used, times in ((400, 0), (500, 0), (501, 1), (1000, 1)):
        calls = []
        heap = Some(totalMemory=lambda: used, maxMemory=lambda: 1000)  # noqa: B023
        lang = Some(Runtime=Some(getRuntime=lambda: heap), System=Some(gc=lambda: calls.append(1)))  # noqa: B023
        tidy(Some(_jvm=Some(java=Some(lang=lang))))
        assert len(calls) == times
