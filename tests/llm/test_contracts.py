"""Contracts: columns of any name, empty tables, the opN queries' columns, and plain-Python versions of what they compute."""

import binascii
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslab.llm import _shared, factorisation, html_text, ngram_ratio, queries, toxicity
from corpuslab.llm.textbatch import Hasher, blocks, lower_latin

RNG = random.Random(21)
VOCAB = [f"wort{k}" for k in range(300)]
CLASHING = "kept long, lang string, _score double, _excess double, _Best double, text string, _passages string, doc int, _doc string, digest long, _digest string, _kept int, component_id string, node long, fp string, row long, source string, doc_id long, n_chars long"


def text(n):
    return " ".join(RNG.choices(VOCAB, k=n))


BASE = text(160)
TEXTS = [None, "", " \n", "wort1", BASE, BASE, BASE.replace("wort7 ", "wort8 ", 1), text(90) + "\n" + BASE[:400], "scum dreck " + text(60), "BUY!! " * 30, text(800), *(text(RNG.randint(40, 120)) for _ in range(40))]


def clashing_row(k, t):
    return (k, "en", 0.5, -1.0, 2.0, t, "p", 3, "d", 4, "e", 5, "c", 6, "f", 7, "s", k, len(t or ""))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Tables as the queries read them, in a folder of their own; `none` has the same tables without rows."""
    root = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([clashing_row(k, t) for k, t in enumerate(TEXTS)], CLASHING)
    labels = spark.createDataFrame([(k, int("BUY" not in (t or "")), int("scum" in (t or ""))) for k, t in enumerate(TEXTS)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    page = "<html><body><nav>menu</nav><article><h1>T{0}</h1><p>{1}</p></article><footer>end</footer></body></html>"
    pages = spark.createDataFrame([(k, f"http://h{k % 2}.org/{k}", page.format(k, text(20))) for k in range(8)] + [(8, None, None), (8, "x", "")], "page_id long, url string, html string")
    for name, df in {"documents": docs, "labels": labels, "pages": pages}.items():
        df.repartition(2).write.parquet(f"{root}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/none/{name}.parquet")
    return str(root)


CONTRACT = {
    "op1_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_sentencepiece": {"doc_id": "bigint"},
    "op4_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double", "class_id": "bigint"},
    "op6_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", CONTRACT)
def test_queries_keep_their_contract(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, f"{sf_dir}/full")
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    rows = found.toPandas()
    if name == "op1_html_text":
        assert len(rows) == 10 and (rows["text"].str.len() == rows["n_chars"]).all() and not rows["text"].str.contains("menu|end").any()
    elif name == "op6_packing":
        assert set(rows["doc_id"]) == set(range(len(TEXTS)))
    else:
        assert sorted(rows["doc_id"]) == list(range(len(TEXTS)))
    for column, mod, rest, limit in (("op7_toxicity", 3, 1, 0.7), ("op10_quality_classifier", 5, 0, 0.3)):
        if name == column:
            assert list(rows["held_out"]) == [binascii.crc32(str(d).encode()) % mod == rest for d in rows["doc_id"]]
            assert list(rows["predicted"]) == [int(s >= limit) for s in rows["score"]] and rows["score"].between(0, 1).all()
    assert queries.QUERIES[name](spark, f"{sf_dir}/none").count() == 0


def test_stages_take_columns_of_any_name_and_empty_tables(spark, sf_dir):
    docs, none = (spark.read.parquet(f"{sf_dir}/{kind}/documents.parquet") for kind in ("full", "none"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{sf_dir}/full")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = {r["doc_id"]: r for r in out.collect()}
        assert all(got[k]["kept"] == k and got[k]["_doc"] == "d" and got[k]["_kept"] == 5 for k in got), name
        assert stage(spark, none, f"{sf_dir}/none").count() == 0, name
        if name == "near_dedup":
            assert {4, 5, 6} & set(got) == {4}
    assert corpus_pipeline.run(spark, f"{sf_dir}/none").count() == 0
    assert corpus_pipeline.run(spark, f"{sf_dir}/full").count() > 0


def test_lookup_equals_a_join(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(100)] + [(None, -1), (99, -2)], "k int, v int")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).filter("k is not null and k <> 99")
    for most in (1, 1000):
        monkeypatch.setattr(_shared, "HOT_KEYS", most)
        for how in ("inner", "left"):
            got, want = _shared.lookup(rows, facts, ["k"], "n", how), rows.join(facts, "k", how)
            assert sorted(map(str, got.select("k", "v", "n", "top").collect())) == sorted(map(str, want.select("k", "v", "n", "top").collect()))


def test_buckets_cut_a_column_into_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000 - 2500).alias("key"))
    bounds = _shared.range_bounds(df, "key", 8)
    assert list(bounds) == sorted(set(bounds)) and 1 <= len(bounds) <= 7
    got = df.select("key", _shared.bucket_of(F.col("key"), bounds).alias("b")).collect()
    assert all(r["b"] == sum(x <= r["key"] for x in bounds) for r in got)
    assert max(Counter(r["b"] for r in got).values()) < 2000
    assert len(_shared.range_bounds(df.limit(0), "key", 8)) == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.shared_dir(Session())


def test_ngram_verdict_by_plain_counters(spark):
    bad, good = "spam klick jetzt kaufen", "das haus steht am fluss"
    rows = [(k, " ".join(RNG.choices((good if k % 2 else bad).split(), k=70))) for k in range(40)]
    labels = [(k, 1) for k in range(1, 40, 4)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")

    def grams(t):
        _, _, data, offsets = next(blocks(pa.array([t])))
        of = Hasher(data)
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        s = ngram_ratio.Structure(data, offsets)
        words = dict(zip((t[a:b] for a, b in spans), ngram_ratio._grams(s)[0][: len(spans)].tolist(), strict=True))
        assert len(words) == len(set(t.split())) and len(ngram_ratio._grams(s)[0]) == 2 * len(spans) - 1 and of is not None
        return Counter(ngram_ratio._grams(s)[0].tolist())

    counts = {k: grams(t) for k, t in rows}
    raw = sum(counts.values(), Counter())
    trusted = sum((counts[k] for k, _ in labels), Counter())
    n, m = sum(raw.values()), sum(trusted.values())
    ratio = {b: math.log((trusted[b] / m + 0.02 * c / n) / 1.02 / (c / n)) for b, c in raw.items()}
    want = {k: sum(ratio[b] * c for b, c in counts[k].items()) / sum(counts[k].values()) for k, _ in rows}
    got = {r["doc_id"]: r for r in ngram_ratio.judge(docs, ngram_ratio.fit(docs, lab), -0.1).collect()}
    for k, t in rows:
        assert got[k]["score"] == pytest.approx(want[k], abs=1e-5)
        assert got[k]["kept"] == (not got[k]["base_failed"] and want[k] >= -0.1)


def test_toxic_log_odds_by_plain_counters(spark):
    rows = [(k, " ".join([*RNG.sample(VOCAB, 20), *(["scumbag", "vile"] if k % 4 == 0 else []), *(["vile"] if k % 40 == 1 else [])])) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, labels.doc_id >= 0)
    yes, no = Counter(), Counter()
    for k, t in rows:
        features = {("w", w) for w in t.split()} | {(n, w[:n]) for w in t.split() for n in toxicity.PREFIXES if len(w) > n}
        (yes if k % 4 == 0 else no).update(features)
    n_yes, n_no = sum(yes.values()), sum(no.values())
    known = dict(zip(model.hashes.tolist(), model.scores.tolist(), strict=True))
    found = 0
    for f in {*yes, *no}:
        a, b = yes[f], no[f]
        prior, mass = 0.1 * (a + b), 0.1 * (n_yes + n_no)
        value = math.log((a + prior) / (n_yes + mass - a - prior)) - math.log((b + prior) / (n_no + mass - b - prior)) - 2 * math.sqrt(1 / (a + prior) + 1 / (b + prior))
        if a >= 3 and a * n_no > 3 * b * n_yes and value > 0.5:
            data = lower_latin(np.frombuffer(f[1].encode(), np.uint8))
            h = int(Hasher(data)(np.array([0]), np.array([len(data)]))[0]) ^ (f[0] if f[0] != "w" else 0)
            assert known[h] == pytest.approx(value)
            found += 1
    assert found == len(known) >= 4


def test_extreme_value_factor_is_the_likeliest():
    rng = np.random.default_rng(5)
    n, rate, k = rng.integers(50, 500, 4000).astype(float), 1.7, 0.02
    best = np.log(k * n / -np.log(rng.random(4000))) / rate  # P(best <= s) = exp(-k n exp(-rate s))
    some, seen = int((best > 0).sum()), float((n * np.exp(-rate * np.maximum(best, 0))).sum())
    assert math.exp(toxicity.log_k_of(some, seen)) == pytest.approx(k, rel=0.1)
    assert toxicity.log_k_of(0, 5.0) == toxicity.log_k_of(None, None) == math.log(0.1)


def test_factorisation_steps_follow_the_gradient():
    """The first Adagrad step against a numeric gradient of the loss."""
    rng = np.random.default_rng(3)
    of = np.arange(0, 31, 3)
    index, value, dense, y = rng.integers(0, factorisation.WORD_BUCKETS, 30), rng.random(30), rng.normal(size=(10, factorisation.N_STATS)), np.array([0.0, 1.0] * 5)
    start = factorisation.train(index, value, of, dense, y, epochs=0)
    after = factorisation.train(index, value, of, dense, y, epochs=1)

    def loss(machine):
        logit = machine.logits(index, value, of, dense)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    assert loss(after) < loss(start)
    for i in {int(index[0]), int(index[7]), factorisation.WORD_BUCKETS + 1}:
        for place, moved in ((start.linear, after.linear), (start.factors[:, 0], after.factors[:, 0])):
            old, eps = place[i], 1e-5
            place[i] = old + eps
            up = loss(start)
            place[i] = old - eps
            down = loss(start)
            place[i] = old
            slope = (up - down) / (2 * eps) + 1e-3 * old
            if abs(slope) > 1e-4:
                assert np.sign(moved[i] - old) == -np.sign(slope)


def brute_templates(pages, share, least, many):
    """Subtrees of all bodies that recur, counted once for each different region of their host."""
    seen, regions = {}, {}
    for url, html in pages:
        host = re.match(r"https?://([^/]+)", url)[1]
        parsed, region = html_text.parse_body(html)
        regions.setdefault(host, set()).add(region)
        for owner in {h for _, owners, _ in parsed for h in owners}:
            seen.setdefault((host, owner), set()).add(region)
    return {k: len(v) for k, v in seen.items() if len(v) >= least and (len(v) >= share * len(regions[k[0]]) or len(v) >= many)}


def test_templates_recur_by_their_counts_alone(spark, monkeypatch):
    """With every list emptied and no region marked, what recurs goes and the rest stays."""
    for name in ("_NEVER", "_NOT_TEXT", "_HEADERS", "_ROLES"):
        monkeypatch.setattr(html_text, name, frozenset())
    own = [text(12) for _ in range(12)]
    box = "<section><b>Buy our</b> paper</section>"
    pages = [(f"http://a.org/{k}", f"<body><div class='nav'><ul><li>Home</li><li>About</li></ul></div><div>{box if k % 2 else ''}<p>{t}</p></div><div class='foot'>Imprint</div></body>") for k, t in enumerate(own)]
    pages += [("http://b.org/1", "<body><div>Home</div><p>lone page</p></body>")]
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    blocks_of = [html_text.parse_body(h) for _, h in pages]
    template = set(brute_templates(pages, 0.1, 3, 1000))
    want = {k: " ".join(t for t, owners, rule in b if rule == html_text.KEEP and not any((re.match(r"http://([^/]+)", pages[k][0])[1], h) in template for h in owners)) for k, (b, _) in enumerate(blocks_of)}
    assert [want[k] for k in range(12)] == own and want[12] == "Home lone page"
    # the workers read the lists of the module as it stands on disk: the decisions are taken from what they send
    found = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert all(own[k] in found[k] and "Imprint" not in found[k] and "Home" not in found[k] and "paper" not in found[k] for k in range(12))


def test_counts_of_templates_match_plain_python(spark):
    pages = [(f"http://a.org/{k}", f"<body><nav><a href='/'>Home</a></nav><article><h1>{text(3)}</h1><div class='box'>Same box</div><p>{text(9)}</p></article><aside>{'x' if k < 2 else 'News'}</aside></body>") for k in range(9)]
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {(r["host"], r["owner"]): r["n"] for r in html_text.site_templates(df).collect()}
    assert got == brute_templates(pages, 0.1, 3, 1000) and len(got) == 3
    texts = [r["text"] for r in html_text.extract(df).collect()]
    assert not any("Same box" in t or "Home" in t or "News" in t for t in texts)


KEPT = [
    ("<article><p>one <span class='ad'>x</span> two</p></article>", "one two"),
    ("<article><p>a <a class='related'>see</a> b</p></article>", "a b"),
    ("<article><section class='search-methods'><p>We searched</p></section></article>", "We searched"),
    ("<header>Site</header><article><header><h1>Title</h1><p>By me</p></header><p>Body</p></article>", "Title Body"),
    ("<article><div class='related-posts'>x</div><div id='comment-12'>y</div><div class='related-work'>z</div></article>", "z"),
]


@pytest.mark.parametrize(("html", "want"), KEPT)
def test_an_article_keeps_its_text(html, want):
    assert " ".join(t for t, _ in html_text.parse(f"<html><body>{html}</body></html>")[0]) == want
