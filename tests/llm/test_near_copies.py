import random

from wanderank.llm import near_copies


def similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / max(len(sets[0] | sets[1]), 1)


def brute_force(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (texts[i] == texts[j] or similarity(texts[i], texts[j]) >= 0.8):
                root = [root[j] if r == root[i] else r for r in root]
    return {frozenset(i for i, r in enumerate(root) if r == k) for k in set(root)}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["", "one two", "one two", "A b c d e", "a  b c\td e"]
    for _ in range(8):
        base = [f"w{rng.randrange(2000)}" for _ in range(200)]
        for k in range(12):  # one changed word moves about five shingles of 196
            copy = list(base)
            for spot in rng.sample(range(200), k):
                copy[spot] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    base = [f"h{i}" for i in range(60)]
    for k in range(150):  # a bucket of many
        texts.append(" ".join([*base[: k % 60], f"x{k}", *base[k % 60 + 1 :]]))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want, got = brute_force(texts), {}
    for r in near_copies.groups(made).collect():
        got.setdefault(r["g"], set()).add(r["id"])
    assert set(map(frozenset, got.values())) == want
    assert {r["doc_id"] for r in near_copies.one_of_each(made).collect()} == {min(g) for g in want}
    assert near_copies.one_of_each(made.where("doc_id < 0")).count() == 0


def test_pipeline_stage_drops_a_copy_with_changed_words(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(200)]
    copies = [
        " ".join(base),
        " ".join(["other" if i in (30, 90, 150) else w for i, w in enumerate(base)]),
        " ".join(["far" if i % 12 == 0 else w for i, w in enumerate(base)]),
    ]
    made = spark.createDataFrame(list(enumerate(copies)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, made, "").collect()} == {0, 2}


def test_parts_of_buckets_and_of_partners_find_the_same_copies(spark, monkeypatch):
    for name, value in {"PART": 8, "PARTNERS": 4, "TRIES": 1, "MORE": 3}.items():
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(70):  # around one original, at similarities of 0.6 to 1 to each other
        copy = list(base)
        for spot in rng.sample(range(120), rng.randrange(4)):
            copy[spot] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in near_copies.groups(made).collect():
        got.setdefault(r["g"], set()).add(r["id"])
    assert set(map(frozenset, got.values())) == brute_force(texts)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
