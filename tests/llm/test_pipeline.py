"""The pipeline's stages on a small corpus with planted copies, near copies and junk."""

import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from spanloom.llm.common import stage


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(4)
    words = [f"{a}{b}" for a in ("ri", "sto", "wa", "qui") for b in ("ver", "ne", "lk", "et", "ly")]
    text = lambda n: " ".join(random.choice(words) for _ in range(n)) + "."
    junk = lambda: " ".join(random.choice(["BUY!!", "$$$", "now!!", "click###"]) for _ in range(90))
    good = {i: text(random.randint(60, 200)) for i in range(300)}
    rows = [(i, t, "en", f"s{i % 5}") for i, t in good.items()]
    rows += [(1000 + i, good[i].upper() if i % 2 else good[i], "en", "s9") for i in range(10)]
    rows += [(2000 + i, good[i] + " Added words.", "en", "s1") for i in range(20, 30)]
    rows += [(3000 + i, junk(), None, None) for i in range(60)]
    rows += [(4000, None, "en", "s1"), (4001, "", None, None)]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(3000 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, held = docs.columns, {}
    for name, step in pipeline.STAGES:
        docs = stage(step(spark, docs, corpus), f"test-{name}")
        held[name] = docs
        if name != "packing":
            assert docs.columns == columns
    got = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in held.items()}
    assert not any(3000 <= i < 4000 for i in got["quality"]) and set(range(300)) <= got["quality"]
    lower = [i for i in range(10) if i % 2 == 0]
    assert not set(lower) & got["exact_dedup"] and {1000 + i for i in lower} <= got["exact_dedup"]
    for i in range(20, 30):
        assert len({i, 2000 + i} & got["near_dedup"]) == 1
    assert set(range(30, 300)) <= got["near_dedup"]

    texts = {r["doc_id"]: r["text"] for r in held["near_dedup"].collect()}
    mixed = held["mixing"].collect()
    words = Counter()
    for r in mixed:
        own, whole = r["text"].split(), Counter(texts[r["doc_id"]].split())
        assert own and not Counter(own) - whole and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(own)
    assert all(n <= 3 * len(texts[i].split()) for i, n in words.items())
    total, sources = sum(len(t.split()) for t in texts.values() if t), Counter()
    for r in mixed:
        sources[r["source"]] += len(r["text"].split())
    assert abs(sum(sources.values()) - total) < 0.02 * total
    assert sources["s1"] / sources["s0"] == pytest.approx(2, rel=0.05) and sources["s2"] / sources["s0"] == pytest.approx(3, rel=0.05)

    packed = held["packing"].collect()
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert all(n == 2048 for s, n in fill.items() if s != max(fill))
    assert pipeline.run(spark, corpus).count() == len(packed)


def test_empty_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for name, step in pipeline.STAGES:
        docs = stage(step(spark, docs, corpus), f"empty-{name}")
        assert docs.count() == 0


def test_rows_of_one_id_and_text_take_turns_of_their_own(spark, corpus):
    rows = [(7, "one two three four five six seven eight", "en", "a", 39), (7, "one two three four five six seven eight", "de", "b", 39), (7, "one two three four five six seven eight", "fr", "b", 39), (8, "nine ten " * 40, "en", "a", 360), (9, "x " * 90, "en", "b", 180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first, second = (sorted(tuple(r) for r in pipeline.mixing(spark, docs.repartition(n, "lang"), corpus).collect()) for n in (1, 3))
    assert first == second
    words = Counter()
    for _, text, _, source, _ in first:
        words[source] += len(text.split())
    assert abs(words["b"] - 2 * words["a"]) <= 3 * 64
    assert {(r[0], r[2], r[3]) for r in first} <= {(r[0], r[2], r[3]) for r in rows}


@pytest.fixture(scope="module")
def sources(spark):
    """Sources of several buckets, with rows that are alike in all columns."""
    random.seed(8)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(random.randint(0, 60))) + " \n" * (i % 2), f"s{i % 3}" if i % 7 else None) for i in range(900)]
    rows += [(5000, "one two three", "s1")] * 40
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_turns_are_the_parts_of_the_schedule(spark, sources):
    """A document's passes by source and bucket are those that the schedule's blocks add up to."""
    from pyspark.sql import functions as F

    from spanloom.llm.mixing import Mix

    for docs in (sources, sources.where("source = 's0' or doc_id < 20")):
        docs = stage(docs.withColumn("n", F.monotonically_increasing_id()), "test-mix")
        plan = Mix(docs, block=16, row="n")
        wanted = {r["row"]: r["taken"] for r in plan.taken().groupBy("row").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken")).collect()}
        ends, extra = plan.turns()
        ends, extra = {r["source_no"]: r for r in ends.collect()}, {r["row"]: r["extra"] for r in extra.collect()}
        got = {}
        for r in plan.placed(plan.rows).collect():
            end = ends[r["source_no"]]
            last = extra[r["row"]] if r["bucket"] == end["edge"] else r["size"] if end["edge"] is not None and r["bucket"] < end["edge"] else 0
            got[r["row"]] = end["turns"] * r["size"] + last
        assert {k: n for k, n in got.items() if n} == wanted
        assert len(extra) < len(got)


def test_mixing_and_exact_copies_leave_texts_where_they_are(spark, sources):
    """Before, all texts were dealt out by number and by digest. Now those of an edge or with copies only."""
    from spanloom.llm.exact_dedup import keep_largest

    sources = stage(sources, "test-sources")
    assert "Union" in pipeline.mixing(spark, sources, "")._jdf.queryExecution().executedPlan().toString()
    rows = {tuple(r) for r in sources.collect()}
    kept = keep_largest(sources)
    best = {}
    for r in rows:
        best[r[1].lower()] = max(best.get(r[1].lower(), r), r, key=lambda x: x[0])
    assert sorted((r[0], r[1]) for r in kept.collect()) == sorted((r[0], r[1]) for r in best.values())
    assert "Union" in kept._jdf.queryExecution().executedPlan().toString()


def test_components_contract_blocks_first(spark, monkeypatch):
    """A block's edges take no step: before, a chain took several. Blocks that meet take steps, and give the same."""
    from spanloom.llm import components as of

    random.seed(2)
    chain = [(i, i + 1) for i in range(3000)]
    edges = chain + [(random.randrange(5000, 8000), random.randrange(5000, 8000)) for _ in range(1200)] + [(9, 9)]
    least = {}
    for a, b in sorted(edges):
        least.setdefault(a, a), least.setdefault(b, b)
    while True:
        moved = [(a, b) for a, b in edges if least[a] != least[b]]
        if not moved:
            break
        for a, b in moved:
            least[a] = least[b] = min(least[a], least[b])
    wanted = {k: v for k, v in least.items() if k != v}
    table = spark.createDataFrame(edges, "a long, b long").repartition(4)
    steps = []
    monkeypatch.setattr(of, "stage", lambda df, name: steps.append(name) or stage(df, name))
    assert {r["node"]: r["component"] for r in of.components(table).collect()} == wanted
    assert len(steps) == 1
    monkeypatch.setattr(of, "BLOCK", 1500)
    assert {r["node"]: r["component"] for r in of.components(table).collect()} == wanted
    assert len(steps) > 2


def test_a_dense_family_is_verified_by_few_pairs(spark, monkeypatch):
    """A family that the first shingles don't unite: its pairs aren't verified one and all, and lists of two groups move no rows. Links at the edge of the threshold are as brute force has them."""
    from spanloom.llm import ngram_jaccard as of

    random.seed(8)
    word = lambda: f"w{random.randrange(10**6)}"

    def changed(base, n):
        own = list(base)
        for at in random.sample(range(len(own)), n):
            own[at] = word()
        return " ".join(own)

    large = [word() for _ in range(400)]
    texts = [changed(large, random.randint(3, 5)) for _ in range(100)]
    for _ in range(60):
        base = [word() for _ in range(random.randint(60, 300))]
        texts += [changed(base, len(base) // 60) for _ in range(2)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    part = list(range(len(texts)))
    find = lambda x: x if part[x] == x else find(part[x])
    links = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                part[max(find(i), find(j))] = min(find(i), find(j))
                links += 1
    assert links > 1000
    pairs, lists, verify, shared = [], [], of.Join.verify, of.Join.shared_lists
    monkeypatch.setattr(of.Join, "verify", lambda self, x, **options: pairs.append(x.count()) or verify(self, x, **options))

    def counted(self, parts):
        out = shared(self, parts)
        held = out[0] if isinstance(out, tuple) else out
        lists.append(Counter(r["h"] for r in held.select("h").collect()))
        return out

    monkeypatch.setattr(of.Join, "shared_lists", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in of.Join(docs).members.collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert sum(pairs) < 10 * len(texts) < links
    assert lists[0] and min(lists[0].values()) > 2
