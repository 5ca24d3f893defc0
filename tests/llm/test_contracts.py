"""Queries against plain versions, and rows that are hard to handle: nulls, repeats, clashing names, empty tables, long texts."""

import html
import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from conftest import DATA
from wanderank.llm import decontaminate, html_extract, mixing, pii, queries, secret_scan, sharding, stream_dedup, token_count, toxicity, trees

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
HARD = [
    (1, "same text here", "en", "a", 1), (1, "same text here", "en", "a", 1), (2, "same text here", "en", None, 1), (None, "same text here", "en", "a", 1), (None, "no id", "en", "a", 1),
    (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n", "en", None, 3), (6, "word " * 30_000, "en", "a", 1), (7, "é" * 60_000, "en", "b", 1),
]


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """A folder of tables: few hard rows, no rows."""
    top = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame(HARD, DOCS).write.parquet(f"{top}/some/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{top}/none/documents.parquet")
    for name in ("some", "none"):
        spark.createDataFrame(
            [(1, 1, 0), (2, 1, 0)] if name == "some" else [],
            "doc_id bigint, quality bigint, toxic bigint",
        ).write.parquet(f"{top}/{name}/labels.parquet")
        spark.createDataFrame(
            [("i1", "same text here"), (None, None)] if name == "some" else [],
            "item_id string, text string",
        ).write.parquet(f"{top}/{name}/benchmark.parquet")
        spark.createDataFrame(
            [(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None)] if name == "some" else [],
            "page_id bigint, url string, html string",
        ).write.parquet(f"{top}/{name}/pages.parquet")
    return top


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_read_hard_rows_and_empty_tables(spark, hard, name):
    rows = queries.QUERIES[name](spark, f"{hard}/some").collect()
    if name == "op10_main_text":
        assert len(rows) == 3
    elif name != "op6_secret_scan":
        assert len(rows) == len(HARD)
    assert queries.QUERIES[name](spark, f"{hard}/none").collect() == []


def test_pipeline_stages_read_hard_rows_and_empty_tables(spark, hard):
    import corpus_pipeline

    for name in ("some", "none"):
        folder = f"{hard}/{name}"
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for clash in (docs, docs.withColumns({"Size": F.lit(1), "__AT": F.lit("x"), "SHARD": F.lit("y"), "score": F.lit(2)})):
            for stage, apply in corpus_pipeline.STAGES:
                out = apply(spark, clash, folder)
                n = out.count()
                want = {"toxicity": len(HARD), "near_duplicates": 5, "decontamination": len(HARD) - 4, "sharding": len(HARD)}
                assert n == 0 if name == "none" else stage not in want or n == want[stage], stage
                if stage != "sharding":
                    assert {c.lower() for c in docs.columns} <= {c.lower() for c in out.columns}


# ---- op1 ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 3, 17])
def test_chunk_maps_compose_to_the_library_s_counts(monkeypatch, chunk):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_count, "CHUNK", chunk)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(["the", " ", "  ", "'s", "é", "中", "12", "\n", "qq", "a"]) for _ in range(rng.randrange(60))) for _ in range(150)] + ["a" * 700, "xyz" * 200, " " * 90]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_count.TokenCounter(open(path, encoding="utf-8").read()).counts(texts).tolist() == want


# ---- op2 ---------------------------------------------------------------------------------------------------


def one_by_one(model, text):
    """Score of one text by forward-backward in logarithms, word by word."""
    words = [w.lower() for w in toxicity.WORD.findall(text)]
    u = [min(30, max(-30, model.potential(w))) for w in words]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    alpha, beta = [], [(0.0, 0.0)] * len(u)
    for t, x in enumerate(u):
        before = model.start if not t else [add(alpha[-1][0] + model.trans[0, j], alpha[-1][1] + model.trans[1, j]) for j in (0, 1)]
        alpha.append((before[0], before[1] + x))
    for t in range(len(u) - 2, -1, -1):
        beta[t] = tuple(add(model.trans[i, 0] + beta[t + 1][0], model.trans[i, 1] + u[t + 1] + beta[t + 1][1]) for i in (0, 1))
    p = [1 / (1 + math.exp(alpha[t][0] + beta[t][0] - alpha[t][1] - beta[t][1])) for t in range(len(u))]
    z = toxicity._summary(np.array(p), np.array([len(p)]))[0] @ model.calibration
    return 1 / (1 + math.exp(-z))


def test_toxicity_query_equals_scores_made_word_by_word(spark):
    model = toxicity.trained(spark, DATA)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = toxicity.query(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["score"] == pytest.approx(one_by_one(model, texts[r["doc_id"]]), abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    sample = {int(t[1:]) for t, _ in toxicity.training_sample(docs, labels)}
    assert sample and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in sample)


def test_spans_are_offsets_of_the_text_as_it_is():
    rng = random.Random(1)
    words = ["".join(rng.choices(["ta", "ro", "mi", "su", "ke"], k=3)) for _ in range(200)]
    made = [(
        " ".join(w for _ in range(15) for w in (rng.choice(words), "zorgle" if i % 2 and rng.random() < 0.2 else rng.choice(words))),
        i % 2,
    ) for i in range(300)]
    scorer = toxicity.Scorer(toxicity.fit(made))
    text = "İİİ ta ZORGLE mi ẞ zorgle"
    _, spans = scorer.scored([text])
    assert [text[a:b] for a, b in spans[0]] == ["ZORGLE", "zorgle"]


def test_most_toxic_documents_are_found_in_every_language(spark):
    """Held-out rows of the larger table; the model learns from the other rows."""
    folder = DATA.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in toxicity.query(spark, folder).where("held_out").select("doc_id", "predicted").collect() if r["doc_id"] in labels]
    for name in ("en", "de", "fr", "es"):
        found = [r["predicted"] for r in rows if labels[r["doc_id"]] and lang[r["doc_id"]] == name]
        assert sum(found) >= 0.9 * len(found) > 0, name
    wrong = [r["predicted"] for r in rows if not labels[r["doc_id"]]]
    assert sum(wrong) <= 0.03 * len(wrong)


# ---- op3 ---------------------------------------------------------------------------------------------------


def test_shards_query_equals_its_contract(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = sharding.query(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    slots = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_cells_of_shards_are_numbered_on_end(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    rows = sharding.shuffle_into_shards(spark.range(3000).withColumn("x", F.lit("same")), 4).collect()
    assert sorted(r["id"] for r in rows) == list(range(3000))
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(750)) for s in range(4))


# ---- op4 ---------------------------------------------------------------------------------------------------


def groups(rows):
    return {(r["file"].rsplit("/", 1)[-1], r["row"]): (r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows}


def test_a_second_run_goes_on_with_new_files_only(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(
        rows,
        "doc_id bigint, text string, AT string, Digest string",
    ).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs[1]{a}"))
    path, state = str(tmp_path / "docs[1]{a}"), str(tmp_path / "state")
    write([(5, "a  b", "x", "y"), (7, "a\tb", "x", "y"), (8, "c", "x", "y"), (None, "d", "x", "y"), (None, "d", "x", "y")])
    first = stream_dedup.deduplicated(spark, path, state).collect()
    assert sorted((r["id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in first if r["id"]) == [(5, 5, 2, True), (7, 5, 2, False), (8, 8, 1, True)]
    nulls = [r for r in first if r["id"] is None]
    assert [r["group_size"] for r in nulls] == [2, 2] and sum(r["kept"] for r in nulls) == 1 and {r["keep_id"] for r in nulls} == {None}
    write([(3, "a b", "x", "y"), (9, "c ", "x", "y"), (10, "c", "x", "y"), (11, "d", "x", "y")])
    files = len(list((tmp_path / "state/rows").glob("batch=*")))
    second = stream_dedup.deduplicated(spark, path, state).collect()
    assert len(list((tmp_path / "state/rows").glob("batch=*"))) == files + 1 and len(second) == 9
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in second if r["id"]}
    assert got == {3: (3, 3, True), 5: (3, 3, False), 7: (3, 3, False), 8: (8, 2, True), 10: (8, 2, False), 9: (9, 1, True), 11: (11, 3, True)}
    assert groups(stream_dedup.deduplicated(spark, path, state).collect()) == groups(second)


def test_bytes_are_compared_when_a_later_run_hits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_dedup.F, "sha2", lambda c, n: F.lit("same"))
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    for rows, want in (([(1, "a")], {1: 1}), ([(2, "b"), (3, "a")], {1: 1, 2: 2, 3: 1})):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(path)
        assert {r["id"]: r["keep_id"] for r in stream_dedup.deduplicated(spark, path, state).collect()} == want


# ---- op5 ---------------------------------------------------------------------------------------------------


def test_mix_gives_each_source_its_target_with_ties_and_repeats(spark, hard):
    rows = [(i % 7, f"w{i % 5} " * (1 + i % 11), "en", "abc"[i % 3 and 1 + i % 2], 1) for i in range(3000)] + [(1, "same same", "en", "c", 1)] * 700
    drawn = mixing.expected_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert len(drawn) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in drawn)
    for s in "abc":
        own = [r for r in drawn if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.02) and own[0]["source_size"] == sum(r["size"] for r in own)
        repeats = [r["taken"] for r in own if r["text"] == "same same"]
        if repeats:
            assert sum(repeats) == pytest.approx(2 * 700 * own[0]["target"] / own[0]["source_size"], abs=4)


# ---- op6 ---------------------------------------------------------------------------------------------------


def candidates(text):
    """Candidates one by one: (kind, start, end, value, before, after); the context ends at other matches of the kind."""
    out = []
    for kind, pattern in secret_scan.GENERATORS.items():
        found, places = [], list(re.finditer(pattern, text, re.A))
        for n, m in enumerate(places):
            start = m.start()
            low, high = places[n - 1].end() if n else 0, places[n + 1].start() if n + 1 < len(places) else len(text)
            if kind == "assigned":
                start += re.match(secret_scan.ASSIGNMENT.replace("(?i)", ""), m[0], re.I).end()
            found.append((kind, start, m.end(), text[start : m.end()], text[max(low, start - 32) : start], text[m.end() : min(high, m.end() + 32)]))
        out += [f for f in found if not any(o[1] < f[2] and f[1] < o[2] for o in out)]
    return out


def test_candidates_and_scores_equal_plain_ones(spark):
    rng = random.Random(4)
    mixed = lambda k: "".join(rng.choices("abcdefXYZ0123456789+/_-", k=k))
    parts = [
        lambda: mixed(rng.randrange(1, 90)),
        lambda: f"password={mixed(rng.randrange(4, 20))}",
        lambda: f"API_KEY : '{mixed(12)}'",
        lambda: "AKIA" + mixed(16).upper(),
        lambda: "ghp_" + mixed(40),
        lambda: "plain words",
        lambda: "=",
        lambda: " ",
        lambda: "\n",
        lambda: f"eyJ{mixed(9)}.{mixed(9)}.{mixed(9)}",
        lambda: "é😀",
        lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{mixed(70)}\n-----END RSA PRIVATE KEY-----",
    ]
    texts = ["".join(rng.choice(parts)() + rng.choice([" ", "", "; "]) for _ in range(rng.randrange(12))) for _ in range(400)] + ["x1" * 600_000]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    made = spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {(r["id"], r["kind"], r["start"], r["end"]): r for r in secret_scan.scanned(made).collect()}
    want = {(i, *c[:3]): c for i, t in enumerate(texts) for c in candidates(t)}
    assert got.keys() == want.keys() and all(got[k]["value"] == want[k][3] for k in want) and len(want) > 500
    # the forest inside the query against the trees walked in Python
    grown, least, _ = secret_scan.model(spark)
    keys = sorted(want)
    table = spark.createDataFrame(
        [(n, want[k][0], want[k][3], want[k][4], want[k][5], f"src{k[0] % 3}") for n, k in enumerate(keys)],
        "n int, kind string, value string, before string, after string, path string",
    )
    x = np.array([r["x"] for r in table.select(
        "n",
        F.array(*secret_scan.features(*map(F.col, ("kind", "value", "before", "after", "path")))).alias("x"),
    ).orderBy("n").collect()])
    score = np.mean([trees.values(t, x) for t in grown], axis=0)
    assert [got[k]["score"] for k in keys] == pytest.approx(score.tolist()) and [got[k]["kept"] for k in keys] == (score >= least).tolist()


def test_forest_keeps_planted_secrets_and_removes_planted_false_alarms(spark):
    planted = [f | {"id": i} for i, f in enumerate(secret_scan.labelled_findings(800, seed=99))]
    made = spark.createDataFrame([(f["id"], f["before"] + f["value"] + f["after"], f["path"]) for f in planted], "doc_id bigint, text string, source string")
    kept = {i: 0 for i in range(len(planted))}
    for r in secret_scan.scanned(made).collect():
        kept[r["id"]] += r["kept"]
    secrets, alarms = [kept[f["id"]] > 0 for f in planted if f["label"]], [kept[f["id"]] > 0 for f in planted if not f["label"]]
    assert np.mean(secrets) > 0.95 and np.mean(alarms) < 0.05


# ---- op7 ---------------------------------------------------------------------------------------------------


def test_trees_select_planted_findings_of_every_kind(spark):
    planted = pii.labelled_findings(1200, seed=99)
    made = spark.createDataFrame([(i, f["before"] + f["value"] + f["after"]) for i, f in enumerate(planted)], "doc_id bigint, text string")
    told = {r["doc_id"]: r["kinds"] for r in pii.personal_data(made).select("doc_id", F.transform("all_spans", lambda s: s["kind"]).alias("kinds")).collect()}
    for kind in pii.MORE:
        own = [(f["label"], kind in told[i]) for i, f in enumerate(planted) if f["kind"] == kind]
        hit, wrong = np.mean([h for y, h in own if y]), np.mean([h for y, h in own if not y])
        assert hit > (0.35 if kind == "local_phone" else 0.75) and wrong < 0.1, (kind, hit, wrong)


def test_spelled_out_addresses_of_any_length_are_proposed(spark):
    long = "a" * 300 + " at " + "b" * 200 + " dot com"
    made = spark.createDataFrame([(0, f"mail to {long} now")], "doc_id bigint, text string")
    spans = pii.personal_data(made).select("all_spans").first()[0]
    assert [(s["kind"], s["value"]) for s in spans] in ([], [("spelled_email", long)])
    rows = pii.with_spans(made, F.col("text"), pii.MORE).select("__spelled_email").first()[0]
    assert [s["value"] for s in rows] == [long]


# ---- op9 ---------------------------------------------------------------------------------------------------


def test_repeated_items_count_once(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([("a", item)] * 50 + [("b", item)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "x y")], "doc_id bigint, text string")
    got = {r["id"]: (r["runs"], r["items"]) for r in decontaminate.hits(docs, bench, block_bytes=30).collect()}
    assert got == {1: ([[1, 13]], ["a", "b"]), 2: ([], [])}


# ---- op10 --------------------------------------------------------------------------------------------------


class Article(HTMLParser):
    """Text of the article element, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.depth, self.skip, self.parts, self.out = 0, 0, [], []

    def cut(self):
        text = " ".join(html.unescape("".join(self.parts)).split())
        self.parts = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.BLOCK_TAGS and self.depth:
            self.cut()
        elif tag in html_extract.VOID_TAGS and self.depth:
            self.parts.append(" ")
        self.skip += tag in ("script", "style")
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK_TAGS and self.depth:
            self.cut()
        self.skip -= tag in ("script", "style")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_main_text_query_equals_the_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = html_extract.query(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = Article()
        page.feed(pages[r["page_id"]] or "")
        page.close()
        assert r["text"] == "\n\n".join(page.out) and r["n_chars"] == len(r["text"])


def test_main_text_of_deep_wide_and_odd_pages(spark):
    deep = "<article>" + "<div>" * 20_000 + "<h1>A deep text</h1><p>It goes on with some words, at last.<p>And with others." + "</div>" * 20_000 + "</article>"
    wide = "<body><nav><a href=x>Home</a></nav><article>" + "<p>Some words of a long story, as it goes on." * 45_000 + "</article></body>"
    formula = "<article><h1>Of sums</h1><p>We write <math><mi>x</mi>+1</math> for the next one, and go on with it.<svg><p>no end</article>"
    pages = [
        (1, "u", deep, "A", 1),
        (1, "u", deep, "A", 1),
        (2, None, wide, None, None),
        (None, "u", None, "A", 1),
        (3, "u", "", "A", 1),
        (4, "u", formula, "A", 1),
    ]
    made = spark.createDataFrame(pages, "page_id bigint, url string, html string, TEXT string, N_Chars int")
    out = html_extract.extracted(made)
    assert [c.lower() for c in out.columns].count("text") == 1
    rows = out.collect()
    texts = [[r["text"] for r in rows if r["page_id"] == i] for i in (1, 2, None, 3, 4)]
    assert texts[0] == ["A deep text\n\nIt goes on with some words, at last.\n\nAnd with others."] * 2 and texts[2:4] == [[""], [""]]
    assert texts[1][0].count("Some words") == 45_000 and "Home" not in texts[1][0]
    assert "x+1" in texts[4][0] and "no end" in texts[4][0]
    assert html_extract.extracted(made.where("page_id > 9")).collect() == []


def test_slices_of_a_page_give_the_scores_of_the_whole():
    model, features = html_extract.trained_labeller(), html_extract.Features()
    page = [b for c, _ in html_extract.training_pages(4, seed=5) for b in c]
    whole = model.scores(features.of([page]), np.array([len(page)]))
    assert model.long_scores(features, page, 7) == pytest.approx(whole)


def test_plain_versions_are_themselves_right():
    assert plain.luhn("4111111111111111") and not plain.luhn("4111111111111112")
